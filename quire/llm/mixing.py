"""Mix sources to target weights by capped water-filling, with whole and fractional repetitions.

Targets: the budget is shared by weight; a source stops at max_epochs times its size, and what it can't take is shared
again by weight among the others until none is above. A source of e epochs takes every document floor(e) times and a
seeded part of them once more: by hash, every document that still fits into the fraction.

Defined results: a null text has size 0; a null source is a source of its own, last in order; where all sizes are 0 all
targets are 0; rows that are equal in doc_id and text share a hash and are taken alike; an empty table gives an empty
result. Reruns agree, as hashes depend on seed, doc_id and text only. A text of any length counts with all
its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, cut_narrow, packed, text_of
from .order import running_before

HASH_BITS, BUCKET_BITS = 52, 12
SPANS = "array<struct<lo:long,hi:long,most:double>>"


def _measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with __key (the source, never null), __size in words and __u, a hash in [0, 2 ** HASH_BITS)."""
    name = F.col(f"`{source}`").cast("string")
    t = text_of(F.col(f"`{text}`"))
    u = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), t).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    key = F.when(name.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), name))
    return docs.withColumns({"__key": key, "__size": F.regexp_count(t, F.lit(r"[^ \t-\r]+")).cast("long"), "__u": u})


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(__key, source_size, target): weights go round over the sources by code point, null last.

    Filling raises one water level: a source's target is min(cap, level * weight). Each round is an aggregation over
    the sources that brings three sums to the driver; it ends when no further source is capped.
    """
    sources = sizes.groupBy("__key").agg(F.sum("__size").alias("source_size"))
    ranked = running_before(sources, [F.col("__key")], F.lit(1), "__rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_narrow(ranked.withColumn("__weight", F.get(turn, (F.col("__rank") % len(weights)).cast("int"))))
    cap, weight = F.col("source_size") * max_epochs, F.col("__weight")
    total = float(ranked.agg(F.sum("source_size").alias("t")).first()["t"] or 0) * share
    level, capped = 0.0, -1
    first = ranked.agg(F.sum(weight).alias("w")).first()["w"] or 1.0
    level = total / first
    while True:
        full = weight * level > cap
        got = ranked.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, weight)).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (total - (got["c"] or 0.0)) / got["w"]
    return ranked.select("__key", "source_size", F.least(cap, weight * level).alias("target"))


def _cuts(sizes: DataFrame, targets: DataFrame, broadcast_rows: int) -> DataFrame:
    """(__key, source_size, target, __whole, __spans, __fill): a document is taken __whole times, and once more if some
    span holds its hash (__lo < __u <= __hi) and it is no larger than the span's __most, or if __u equals __fill.

    Documents are gone through by hash, and each that fits into what is still wanting is taken. A round of that is one
    span: it ends before the first document that no longer fits, and the next goes on beyond it among those small enough.
    Its end is found in a histogram of hashes, then among the documents of one bucket alone. Rounds end when no source
    has a document left that fits. What is then still wanting goes to the one document left whose size comes nearest to
    it, if that helps.
    """
    size = F.greatest("source_size", F.lit(1))
    whole = F.floor(F.col("target") / size).cast("long")
    need = cut_narrow(targets.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")))
    bucket = F.shiftright("__u", HASH_BITS - BUCKET_BITS)
    state = need.select("__key", F.lit(-1).cast("long").alias("__lo"), "__rest").where(F.col("__rest") >= 1)
    left, spans, ends = sizes, None, None
    while state.limit(1).count():
        here = left.join(_few(state, broadcast_rows), "__key").where((F.col("__u") > F.col("__lo")) & (F.col("__size") <= F.col("__rest")))
        here = cut_narrow(here.select("__key", "__size", "__u"))
        histogram = here.groupBy("__key", bucket.alias("__bucket")).agg(F.sum("__size").alias("__n"))
        w = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        histogram = cut_narrow(histogram.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(state, "__key"))
        edge = histogram.where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__n")))
        edge = cut_narrow(edge.select("__key", "__bucket", "__before", (F.col("__rest") - F.col("__before")).alias("__left")))
        at_edge = here.withColumn("__bucket", bucket).join(edge, ["__key", "__bucket"])
        by_hash = Window.partitionBy("__key").orderBy("__u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        at_edge = at_edge.withColumn("__reached", F.sum("__size").over(by_hash))
        fits = F.col("__reached") <= F.col("__left")
        stop = at_edge.groupBy("__key", "__before").agg(F.min(F.when(~fits, F.col("__u"))).alias("__stop"), F.max(F.when(fits, F.col("__reached"))).alias("__last"))
        stop = stop.select("__key", "__stop", (F.col("__before") + F.coalesce("__last", F.lit(0))).alias("__taken"))
        every = histogram.groupBy("__key").agg(F.sum("__n").alias("__all"))
        done = cut_narrow(state.join(every, "__key", "left").join(stop, "__key", "left"))
        taken = F.coalesce("__taken", "__all", F.lit(0))
        span = done.select("__key", "__lo", (F.coalesce("__stop", F.lit(1 << HASH_BITS)) - 1).alias("__hi"), F.col("__rest").alias("__most"))
        spans = span if spans is None else spans.unionByName(span)
        end = done.select("__key", (F.col("__rest") - taken).alias("__rest"), "__stop")
        over = end.where(F.col("__stop").isNull() | (F.col("__rest") < 1)).select("__key", "__rest")
        ends = over if ends is None else ends.unionByName(over)
        state = end.where(F.col("__stop").isNotNull() & (F.col("__rest") >= 1)).select("__key", F.col("__stop").alias("__lo"), "__rest")
        left = here
    if spans is None:
        return cut_narrow(need.select("__key", "source_size", "target", "__whole", F.array().cast(SPANS).alias("__spans"), F.lit(-1).cast("long").alias("__fill")))
    spans = spans.groupBy("__key").agg(F.collect_list(F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.col("__most").alias("most"))).alias("__spans"))
    cuts = cut_narrow(need.drop("__rest").join(spans, "__key", "left").join(ends, "__key", "left").withColumn("__spans", F.coalesce("__spans", F.array().cast(SPANS))))
    beyond = sizes.join(_few(cuts, broadcast_rows), "__key").where((F.col("__size") < 2 * F.col("__rest")) & ~_in_spans())
    copies = beyond.groupBy("__key", "__u", "__rest").agg(F.sum("__size").alias("__size"))
    off = F.abs(F.col("__size") - F.col("__rest"))
    fill = copies.where(off < F.col("__rest")).groupBy("__key").agg(F.min(F.struct(off.alias("off"), F.col("__u").alias("u"))).alias("__best"))
    cuts = cuts.join(fill, "__key", "left").withColumn("__fill", F.coalesce(F.col("__best")["u"], F.lit(-1)))
    return cut_narrow(cuts.select("__key", "source_size", "target", "__whole", "__spans", "__fill"))


def _in_spans() -> Column:
    return F.exists("__spans", lambda x: (x["lo"] < F.col("__u")) & (F.col("__u") <= x["hi"]) & (F.col("__size") <= x["most"]))


def _few(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has no more rows than that."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _times() -> Column:
    return F.col("__whole") + F.when(_in_spans() | (F.col("__u") == F.col("__fill")), 1).otherwise(0)


def _plan(sizes: DataFrame, weights: list[float], share: float, max_epochs: float, broadcast_rows: int) -> DataFrame:
    return _few(_cuts(sizes, source_targets(sizes, weights, share, max_epochs), broadcast_rows), broadcast_rows)


def mix_report(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: int = 8, broadcast_rows: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every row; texts are read once."""
    measured = _measured(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((doc_id, text, source))]), doc_id, text, source, seed)
    sizes = cut(measured.select(F.col(f"`{doc_id}`").alias("doc_id"), "__key", "__size", "__u"))
    out = sizes.join(_plan(sizes, weights, share, max_epochs, broadcast_rows), "__key")
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * _times()).alias("taken"))


def mixed(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: int = 8, broadcast_rows: int = 20_000) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is taken. Texts are read twice, not shuffled
    where the sources are few enough to broadcast."""
    own = packed(docs, doc_id=F.col(f"`{doc_id}`"), text=F.col(f"`{text}`"), source=F.col(f"`{source}`"))
    measured = _measured(own, "doc_id", "text", "source", seed)
    sizes = cut(measured.select("__key", "__size", "__u"))
    out = measured.join(_plan(sizes, weights, share, max_epochs, broadcast_rows), "__key").where(_times() > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), _times())).alias("__time")).select("row.*")
