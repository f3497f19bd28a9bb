"""quire: document analytics as Spark DataFrames."""
