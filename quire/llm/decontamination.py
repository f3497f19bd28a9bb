"""Benchmark decontamination by winnowing: spans that training documents share with test items.

A text's fingerprints are the minima of its k-gram hashes in sliding windows of `span - k + 1` k-grams, so each run of
`span` words has one, and equal runs have the same: no shared run of that length can be missed. Documents keep the runs
whose fingerprint an item has; those meet the items' runs by fingerprint and are extended to the whole span, compared word
by word. An item shorter than `span` is one run of its own length.

All of it are column functions. The words, hashes and minima of a text are arrays in its row; a bit table of the items'
fingerprints, of bounded size, picks the runs that can meet an item, so a clean text leaves one narrow row. Where the items
have more fingerprints than that table is meant for, the fingerprints of both sides are joined by shuffle instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow, let, lower_ascii, text_of

# Fixed value of the contract: all of ASCII but digits and lower-case letters separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 10, 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _spread(values: Column, length: int, join: Callable[[Column, Column], Column]) -> Column:
    """join over each run of `length` neighbours, by doubling: shorter by length - 1, empty where there are fewer."""

    def shifted(a: Column, by: int) -> Column:
        rest = F.greatest(F.size(a) - by, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), rest), F.slice(a, F.lit(by + 1), rest), join)

    def go(a: Column, done: int) -> Column:
        if done == length:
            return a
        by = min(done, length - done)
        return let(shifted(a, by), lambda b: go(b, done + by))

    return go(values, 1)


def fingerprints(words: Column, span: int, gram: int = GRAM) -> Column:
    """The fingerprint of each run of `span` words, in order: the smallest hash of its k-grams."""
    k = min(gram, span)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(_spread(h, k, lambda a, b: F.xxhash64(a, b)), lambda g: _spread(g, span - k + 1, lambda a, b: F.least(a, b))))


def _runs(words: Column, span: int, gram: int, known: Callable[[Column], Column] | None = None) -> Column:
    """Structs (at, span, fp, run) of the runs of `span` words whose fingerprint is known; run is their text."""

    def body(m: Column) -> Column:
        every = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        some = every if known is None else F.filter(every, lambda i: known(F.get(m, i)))
        run = lambda i: F.array_join(F.slice(words, i + 1, F.lit(span)), " ")
        return F.transform(some, lambda i: F.struct(i.alias("at"), F.lit(span).alias("span"), F.get(m, i).alias("fp"), run(i).alias("run")))

    return let(fingerprints(words, span, gram), body)


def item_runs(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(fp, run, span, item): the distinct runs of all items that have words. A row without item_id counts as an empty id."""
    worded = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words_of(text_of(F.col(f"`{text}`"))).alias("words"))
    size = F.size("words")
    own = _runs(F.col("words"), span, gram)
    for length in range(1, span):
        own = F.when(size == length, _runs(F.col("words"), length, gram)).otherwise(own)
    return worded.where(size > 0).select("item", F.inline(own)).select("fp", "run", "span", "item").distinct()


def _bit_table(known: DataFrame, count: int, bits_each: int) -> Callable[[Column], Column]:
    """A test of a hash: false only if it isn't in known.fp. The bits come to the driver as words of 64, and go out again as
    one constant; their number follows from count, which the caller has bounded."""
    size = 1 << max(6, (count * bits_each - 1).bit_length())
    bit = F.col("fp").bitwiseAND(F.lit(size - 1))
    word = F.shiftright(bit, 6).cast("int")
    rows = known.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = [0] * (size // 64)
    for r in rows:
        words[r["w"]] = r["b"]
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def test(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(size - 1))
        there = F.call_function("shiftright", F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
        return there.bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def _all_runs(words: Column, spans: list[int], gram: int, known: Callable[[Column], Column]) -> Column:
    return F.concat(*[_runs(words, span, gram, known) for span in spans])


def document_runs(docs: DataFrame, known: DataFrame, spans: list[int], doc_id: str, text: str, gram: int, table_rows: int, bits_each: int = 256) -> DataFrame:
    """(row, doc_id, n_words, runs) for each row of docs: the runs whose fingerprint can be one of known.fp. Written out."""
    count = known.count()
    words = words_of(text_of(F.col(f"`{text}`")))
    row, key = F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id")
    if not count:
        none = F.array().cast("array<struct<at:int,span:int,fp:bigint,run:string>>")
        return cut(docs.select(row, key, F.size(words).cast("long").alias("n_words"), none.alias("runs")))
    if count <= table_rows:
        test = _bit_table(known, count, bits_each)
        own = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _all_runs(w, spans, gram, test).alias("runs")))
        return cut(docs.select(row, key, own.alias("own")).select("row", "doc_id", "own.n_words", "own.runs"))
    worded = cut(docs.select(row, key, words.alias("words")))
    hashes = F.array_distinct(F.concat(*[fingerprints(F.col("words"), span, gram) for span in spans]))
    met = worded.select("row", F.explode(hashes).alias("fp")).join(known, "fp", "left_semi").groupBy("row").agg(F.collect_set("fp").alias("met"))
    runs = _all_runs(F.col("words"), spans, gram, lambda h: F.array_contains(F.col("met"), h))
    empty = F.array().cast("array<bigint>")
    joined = worded.join(met, "row", "left").withColumn("met", F.coalesce("met", empty))
    return cut(joined.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), runs.alias("runs")))


def covered(spots: Column) -> Column:
    """How many positions structs (at, span) cover, overlaps once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, spot: Column) -> Column:
        end = F.greatest(acc["end"], spot["at"] + spot["span"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], spot["at"])).cast("long").alias("n"))

    return F.aggregate(F.array_sort(spots), start, step, lambda acc: acc["n"])


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, gram: int = GRAM, table_rows: int = 200_000, broadcast_bytes: int = 1 << 25,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for every row of docs: how many words stand in a run of `span` words
    that an item has too (or in a whole shorter item), and the ids of those items, as strings in order.

    Defined results: a null text has no words; rows that repeat a doc_id, or have none, each get their own result; items
    that repeat an id count once, those without one as an empty id, those without words not at all; no items or no documents
    give no hits or no rows; other columns aren't read. A text of any length is worked on in its own row.
    """
    shared = cut_narrow(item_runs(items, item_id, item_text, span, gram))
    spans = sorted(r["span"] for r in shared.select("span").distinct().collect())  # span numbers at most
    there = document_runs(docs, shared.select("fp").distinct(), spans, doc_id, text, gram, table_rows)
    size = shared.agg(F.sum(F.octet_length("run") + F.octet_length("item") + 64).alias("b")).first()["b"] or 0
    found = there.select("row", F.inline("runs")).join(F.broadcast(shared) if size <= broadcast_bytes else shared, ["fp", "run", "span"])
    hits = found.groupBy("row").agg(F.collect_set(F.struct("at", "span")).alias("spots"), F.collect_set("item").alias("items"))
    n_hit = F.coalesce(covered(F.col("spots")), F.lit(0).cast("long"))
    ids = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return there.select("row", "doc_id", "n_words").join(hits, "row", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("items"), F.col("spots").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns, that share no run with an item."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id")
    packed = docs.select(row, F.col(f"`{text}`").alias("text"))
    return decontaminate(packed, items, "doc_id", "text", item_id, item_text, **settings).where("not contaminated").select("doc_id.*")
