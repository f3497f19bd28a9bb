"""Work in a global order without a global window: range buckets, and running sums over them."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_narrow


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Up to buckets - 1 ascending bounds that split the long column key into runs of about equal row counts.

    Beyond 100 rows a bucket they come from a sample of the keys of about that size, as a digest of all would outgrow one
    task. They only say where rows go; every row is dealt out by them.
    """
    shares = [k / buckets for k in range(1, buckets)]
    if not shares:
        return []
    keys = df.select(F.col(key).alias("k"))
    some = min(1.0, 100 * buckets / max(1, keys.count()))
    found = (keys.sample(some, 1) if some < 1 else keys).agg(F.percentile_approx("k", shares, 20 * buckets).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key; null keys count as smallest. Two short scans, of about sqrt(len(bounds)) each."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    array = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    block = F.greatest(below(array(bounds[::step])) - 1, F.lit(0))
    found = block * step + below(F.slice(array(bounds), block * step + 1, F.lit(step)))
    return F.when(key.isNull(), 0).otherwise(found).cast("int")


def running_before(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Add the sum of amount over all rows before a row in the global order (a long; ties in any order).

    Rows are dealt into ranges; one total a range, so as many as there are partitions, comes to the driver and goes back
    as prefix sums; inside a range a window adds up. The ranges are written out first, so they can't shift on a rerun.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_narrow(df.repartitionByRange(n, *order).withColumns({"__range": F.spark_partition_id(), "__amount": amount.cast("long")}))
    totals = sorted((r["__range"], r["t"]) for r in dealt.groupBy("__range").agg(F.sum("__amount").alias("t")).collect())
    base, at = [], 0
    for k, t in totals:
        base.append((k, at))
        at += t or 0
    bases = df.sparkSession.createDataFrame(base or [(0, 0)], "__range int, __base long")
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__inside", F.coalesce(F.sum("__amount").over(w), F.lit(0)))
    return summed.join(F.broadcast(bases), "__range").withColumn(name, F.col("__base") + F.col("__inside")).drop("__range", "__amount", "__base", "__inside")
