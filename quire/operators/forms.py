"""Form calculations and exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import FormError, expression
from quire.functions.numbers import calculation_text, form_number


def calculated(rows: DataFrame, calculations: list[tuple[str, str]], numeric: list[str] | None = None) -> DataFrame:
    """Apply (target, expression) pairs in order to columns; later ones see earlier results as numbers, not rounded.

    Each target is added as text (an integer, or two decimals without trailing zeros). Columns that aren't numeric are
    read as form values.
    """
    kinds = dict(rows.dtypes)
    fields = {c: (form_number(F.col(c)) if k == "string" else F.col(c)) for c, k in kinds.items() if numeric is None or c in numeric}
    out = rows
    for target, text in calculations:
        out = out.withColumn(f"__{target}", expression(text, fields))
        fields[target] = F.col(f"__{target}")
        out = out.withColumn(target, calculation_text(F.col(f"__{target}")))
    return out.drop(*[f"__{t}" for t, _ in calculations])


def form_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """(all but the JSON, name, value) of form data: {"fields": [{name, value}]} or a bare map. Numbers and booleans
    become text, arrays the text of their strings, joined by a comma and a space; nulls, objects and entries without a
    name go. Whatever a string holds is kept."""
    parsed = F.try_parse_json(F.col(column))
    kind = lambda v: F.schema_of_variant(v)
    joined = lambda v: F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull()), ", ")
    text = lambda v: F.when(F.startswith(kind(v), F.lit("OBJECT")) | F.is_variant_null(v), F.lit(None)).when(F.startswith(kind(v), F.lit("ARRAY")), joined(v)).otherwise(F.try_variant_get(v, "$", "string"))
    listed = F.try_variant_get(F.col("__v"), "$.fields", "array<struct<name:string,value:variant>>")
    bare = F.transform(F.map_entries(F.try_variant_get(F.col("__v"), "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    keep = [c for c in rows.columns if c != column]
    out = rows.withColumn("__v", parsed).select(*keep, F.explode(F.coalesce(listed, bare)).alias("f")).select(*keep, "f.name", text(F.col("f.value")).alias("value"))
    return out.where("name is not null and value is not null")


# The kinds of batch steps, in the order in which they may run.
PHASES = {"pages": 0, "ocr": 1, "image": 2, "page-labels": 3, "stamp": 4, "metadata": 5, "text-export": 6, "compress": 7, "protect": 8}


def batch_plan(steps: DataFrame) -> DataFrame:
    """Add place and reordered to (rule_set, ord, kind): steps sorted by phase, ties by their own order."""
    from pyspark.sql.window import Window

    phase = F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    place = F.row_number().over(Window.partitionBy("rule_set").orderBy(phase, "ord")) - 1
    return steps.withColumn("place", place).withColumn("reordered", F.col("place") != F.col("ord"))


def checked_rules(rules: dict) -> list[dict]:
    """The steps of a rule set, refused unless version, kinds and parameters are sound."""
    steps = rules.get("steps")
    if rules.get("version") != 1 or not isinstance(steps, list) or not steps:
        raise FormError("a rule set has version 1 and at least one step")
    for s in steps:
        if s.get("kind") not in PHASES or not isinstance(s.get("params", {}), dict):
            raise FormError(f"unknown or unsound step: {s!r}")
    return steps


def batch_run(items: DataFrame, step, most_items: int, most_bytes: int) -> DataFrame:
    """(item, status, note) for (item, bytes, text): done, failed or skipped. A failure stays with its item; items beyond
    the bounds of count or running size are skipped, and don't count."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("batch").orderBy("item")
    first = items.where(F.col("bytes") <= most_bytes).select("batch", "item", "bytes").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_items)  # at most so many a batch are gathered
    status = first.withColumn("used", F.sum("bytes").over(w)).select("batch", "item", (F.col("used") <= most_bytes).alias("ok"))
    both = items.join(status, ["batch", "item"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    def run(batches):
        for b in batches:
            rows = []
            for group, item, text, ok in b[["batch", "item", "text", "ok"]].itertuples(index=False):
                if not ok:
                    rows.append((group, item, "skipped", "over a bound"))
                    continue
                try:
                    rows.append((group, item, "done", str(step(text))))
                except Exception as e:  # noqa: BLE001 - a failing item must not stop the others
                    rows.append((group, item, "failed", type(e).__name__))
            yield type(b)(rows, columns=["batch", "item", "status", "note"])

    return both.mapInPandas(run, "batch long, item long, status string, note string")


def field_text(value: Column, chosen: Column, checked: Column) -> Column:
    """A field's value as text: a tick for a box that is checked, chosen options joined by a comma, or the text itself."""
    return F.coalesce(F.when(checked, F.lit("✓")), F.array_join(chosen, ", "), value, F.lit(""))
