"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what fixed patterns find: email, ip, card, phone, and secret (a run of letters and digits that is set to a name
for credentials). Every other token with a digit or an at sign is a mention.
The lexical patterns of a seed or mention are the two words before it, the word before it, the word after it, and the
words on either side. Over the graph of patterns and instances (tokens) rounds of scoring run:

1. A pattern's score for a kind is the share of the kind among what is known behind it: different instances of the kind
   over all known ones and one more. Known are seeds, what earlier rounds found, and, as none of any kind, mentions that
   can identify nobody (under five digits and no at sign). What isn't known yet counts neither way. Its score for
   identifiers at all is reckoned in the same way.
2. A pattern of score `least_pattern` with `support` different instances of the kind is trusted, unless as many could
   stand there by chance: by Chernoff's bound, words that are strewn at random before known instances would make fewer
   than `chance` trusted patterns in all. So the support that is needed grows with the log of the number of patterns.
3. A mention behind a trusted pattern is found if its shape is one that instances of the kind have (shapes are induced
   from seeds and from what was found), and if the mean score for identifiers of all its patterns that know anything
   reaches `least`.
4. What is found counts as a seed from then on, and the next round begins; rounds end when none is added.

Defined results: a null text counts as empty; repeated rows come back repeated, with the same spans; an empty table
gives an empty result; of kinds with equal scores the first listed wins. Offsets are code points, ends exclusive. Very
long runs of digits or dots cost linear time: the expressions are possessive and start only where a run starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, cut_narrow, let, packed, text_of

# Kinds in report order, what a text must hold for a kind to be worth a search, and the expression.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
# Names that credentials are set to.
SECRET_NAMES = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential"
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{11,}[0-9]", "phone": r"\+[0-9]", "secret": r"[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.=-]{8}"}
FIXED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": rf"(?i)(?<=(?:{SECRET_NAMES})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)(?<![A-Z0-9+/_.-])(?:[+/_.=-]*+[A-Z0-9]++)++",
}
TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
TRAILING = "[.,;:!?)\"'\\]}>]+$"
SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
MENTION = "struct<rank:int,s:int,e:int,instance:string,shape:string,patterns:array<string>>"
NONE = len(KINDS)  # the rank of what is known to be of no kind


def _running(numbers: Column, piece: int = 256) -> Column:
    """Running sums of an array, a piece at a time: an array that grows by one element a step is copied each time."""

    def sums(array: Column, base: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
        return F.aggregate(array, F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of(numbers: Column) -> Column:
        count = F.ceil(F.size(numbers) / piece).cast("int")
        pieces = F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda k: F.slice(numbers, k * piece + 1, F.lit(piece)))
        totals = lambda p: F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n))
        return let(pieces, lambda p: F.flatten(F.zip_with(p, F.slice(F.concat(F.array(F.lit(0)), sums(totals(p), F.lit(0))), F.lit(1), F.size(p)), sums)))

    return let(numbers, of)


def _matches(text: Column, expression: str) -> Column:
    """Leftmost non-overlapping matches with their places, and the text since and until the neighbouring matches (the
    text before holds the match before, so that a word stands before all but a text's first match)."""
    gap = F.split(text, expression, -1)
    parts = let(
        F.struct(F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("m"), gap.alias("gap")),
        lambda x: F.arrays_zip(
            x["m"].alias("m"), F.slice(x["gap"], F.lit(1), F.size(x["m"])).alias("gap"), F.slice(x["gap"], F.lit(2), F.size(x["m"])).alias("after"),
            F.slice(F.concat(F.array(F.lit("")), x["m"]), F.lit(1), F.size(x["m"])).alias("last"),
        ),
    )
    span = lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"), F.concat(x["last"], x["gap"]).alias("before"), x["after"].alias("after"))
    return let(parts, lambda p: F.zip_with(p, _running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["m"]))), span)).cast(SPAN)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "secret":
        return (F.length(m) >= 8) & m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _bare(word: Column) -> Column:
    """A word of a pattern: small letters, without marks at its ends."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place between two texts; blank words make none."""
    words = F.split(F.btrim(before, F.lit(SPACE_CHARS)), SPACE + "+")
    two, one = _bare(F.get(words, F.size(words) - 2)), _bare(F.element_at(words, -1))
    nxt = _bare(F.regexp_extract(after, r"^[^ \t-\r]*[ \t-\r]+([^ \t-\r]+)", 1))
    made = [
        F.when((one != "") & (two != ""), F.concat(F.lit("2 "), two, F.lit(" "), one)),
        F.when(one != "", F.concat(F.lit("< "), one)),
        F.when(nxt != "", F.concat(F.lit("> "), nxt)),
        F.when((one != "") & (nxt != ""), F.concat(F.lit("| "), one, F.lit(" "), nxt)),
    ]
    return F.array_compact(F.array(*made))


def _shape(token: Column) -> Column:
    """What a token is made of: an at sign, colons, digits with letters, with other marks, or alone."""
    return F.when(token.contains("@"), "at").when(token.contains(":"), "colon").when(token.rlike(r"\p{L}"), "letters").when(token.rlike("[^0-9]"), "marks").otherwise("digits")


def _mention(rank: Column, s: Column, e: Column, token: Column, before: Column, after: Column) -> Column:
    parts = {"rank": rank, "s": s, "e": e, "instance": F.lower(token), "shape": _shape(token), "patterns": _patterns(before, after)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _seeds(text: Column, kind: str) -> Column:
    """Valid matches of a kind."""
    good = F.filter(_matches(text, FIXED[kind]), lambda x: _valid(kind, x["m"]))
    rank = F.lit(KINDS.index(kind))
    return F.when(text.rlike(WORTH[kind]), F.transform(good, lambda x: _mention(rank, x["s"], x["e"], x["m"], x["before"], x["after"]))).otherwise(F.array().cast(f"array<{MENTION}>"))


def _candidates(text: Column, seeds: Column) -> Column:
    """Mentions that overlap no seed; those that can identify nobody have the rank NONE, the others have none."""
    bare = lambda x: F.regexp_replace(x["m"], TRAILING, "")
    weak = lambda x: ~x["m"].contains("@") & (F.length(_digits(x["m"])) < 5)
    free = lambda x: ~F.exists(seeds, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    tokens = F.filter(_matches(text, TOKEN), free)
    rank = lambda x: F.when(weak(x), NONE)
    made = F.transform(tokens, lambda x: _mention(rank(x), x["s"], x["s"] + F.length(bare(x)), bare(x), x["before"], F.concat(F.right(x["m"], F.length(x["m"]) - F.length(bare(x))), x["after"])))
    return F.when(text.rlike("[0-9@]"), made).otherwise(F.array().cast(f"array<{MENTION}>"))


def with_seeds(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add __text (never null), __seeds: the base spans, and __cands: the other mentions."""
    out = docs.withColumn("__text", text_of(F.col(f"`{text}`")))
    for kind in KINDS:
        out = out.withColumn(f"__{kind}", _seeds(F.col("__text"), kind))
    out = out.withColumn("__seeds", F.concat(*[f"__{kind}" for kind in KINDS])).drop(*[f"__{kind}" for kind in KINDS])
    return out.withColumn("__cands", _candidates(F.col("__text"), F.col("__seeds")))


def _edges(marked: DataFrame) -> DataFrame:
    """(pattern, instance, shape, rank): which instances stand behind a pattern. rank is the kind of a seed, NONE for what
    can be of no kind, null for what is to be judged. A token that is a seed anywhere is one behind every pattern."""
    mentions = marked.select(F.explode(F.concat("__seeds", "__cands")).alias("x"))
    pairs = mentions.select("x.instance", "x.shape", "x.rank", F.explode("x.patterns").alias("pattern"))
    pairs = cut_narrow(pairs.groupBy("pattern", "instance").agg(F.min("shape").alias("shape"), F.min("rank").alias("rank")))
    ranks = mentions.where(f"x.rank < {NONE}").groupBy("x.instance").agg(F.min("x.rank").alias("own"))  # with or without a pattern
    open_ = pairs.where(f"rank is null or rank = {NONE}").join(ranks, "instance", "left")
    settled = open_.select("pattern", "instance", "shape", F.coalesce("own", "rank").alias("rank"))
    return cut_narrow(pairs.where(f"rank < {NONE}").select("pattern", "instance", "shape", "rank").unionByName(settled))


def pattern_scores(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(pattern, n, one count a kind (n0 and so on), kind, score, any) of every pattern that knows anything: how many known instances stand
    behind it, how many of each kind, the likeliest kind (null for none), its score, and the score for identifiers of any
    kind. found: (instance, kind) of earlier rounds."""
    known = edges if found is None else edges.join(found, "instance", "left").withColumn("rank", F.coalesce("rank", "kind"))
    known = known.where("rank is not null")
    of = lambda k: F.count(F.when(F.col("rank") == k, 1))
    counts = known.groupBy("pattern").agg(F.count("*").alias("n"), *[of(k).alias(f"n{k}") for k in range(NONE)])
    best = F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("k")) for k in range(NONE)])
    kind = F.when(best["n"] > 0, -best["k"]).alias("kind")
    return counts.select("*", kind, (best["n"] / (F.col("n") + 1)).alias("score"), (sum(F.col(f"n{k}") for k in range(NONE)) / (F.col("n") + 1)).alias("any"))


def with_trust(scores: DataFrame, least_pattern: float, support: int, chance: float) -> DataFrame:
    """Add `sure` to pattern_scores(): whether a pattern is trusted. A sum a kind comes to the driver, and two more."""
    own = F.get(F.array(*[F.col(f"n{k}") for k in range(NONE)]), F.col("kind"))
    enough = own >= support
    sums = scores.agg(F.count(F.when(enough, 1)).alias("patterns"), F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(NONE)]).first()
    # at least half of what stands behind an arbitrary pattern is taken for something else
    usual = F.get(F.array(*[F.lit(min(0.5, ((sums[f"n{k}"] or 0) + 1) / ((sums["n"] or 0) + 2))) for k in range(NONE)]), F.col("kind"))
    rest = F.col("n") - own
    gain = own * F.ln(own / (F.col("n") * usual)) + F.when(rest > 0, rest * F.ln(rest / (F.col("n") * (1 - usual)))).otherwise(0.0)
    sure = enough & (F.col("score") >= least_pattern) & (own > F.col("n") * usual) & (gain >= math.log(max(1, sums["patterns"]) / chance))
    return scores.withColumn("sure", F.coalesce(sure, F.lit(False)))


def found_instances(edges: DataFrame, least_pattern: float = 0.75, least: float = 0.6, support: int = 3, chance: float = 0.1) -> DataFrame:
    """(instance, kind) of the mentions that the rounds find; only sums and counts come to the driver."""
    spark = edges.sparkSession
    open_ = edges.where("rank is null").select("pattern", "instance", "shape")
    found, count = spark.createDataFrame([], "instance string, kind int"), 0
    while True:
        scores = cut_narrow(with_trust(cut_narrow(pattern_scores(edges, found if count else None)), least_pattern, support, chance))
        if scores.where("sure").isEmpty():
            return found
        behind = open_.join(scores, "pattern")
        top = F.max(F.when(F.col("sure"), F.struct("score", (-F.col("kind")).alias("k"))))
        judged = behind.groupBy("instance", "shape").agg(top.alias("top"), F.avg("any").alias("mean")).where(F.col("top").isNotNull() & (F.col("mean") >= least))
        judged = judged.withColumn("kind", -F.col("top.k"))
        shapes = edges.where(f"rank < {NONE}").select("shape", F.col("rank").alias("kind"))
        if count:
            shapes = shapes.unionByName(open_.join(found, "instance").select("shape", "kind"))
        new = judged.join(F.broadcast(shapes.distinct()), ["shape", "kind"]).select("instance", "kind")  # a row a kind and shape at most
        found = cut_narrow((new.unionByName(found) if count else new).groupBy("instance").agg(F.min("kind").alias("kind")))
        before, count = count, found.count()
        if count == before:
            return found


def discovered(marked: DataFrame, keys: list[str]) -> DataFrame:
    """keys and __found: the spans of found instances, and of secrets that are seeds elsewhere (those of other kinds are
    seeds wherever they stand)."""
    secrets = marked.select(F.explode("__seeds").alias("x")).where(F.col("x.rank") >= len(BASE)).select("x.instance", F.col("x.rank").alias("kind"))
    found = found_instances(_edges(marked)).unionByName(secrets).groupBy("instance").agg(F.min("kind").alias("kind"))
    spans = marked.select(*keys, F.explode("__cands").alias("x")).where("x.rank is null").select(*keys, "x.instance", "x.s", "x.e")
    spans = spans.join(found, "instance").select(*keys, F.struct(F.col("kind").alias("rank"), "s", "e").alias("span"))
    return spans.groupBy(*keys).agg(F.collect_set("span").alias("__found"))


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _all_spans() -> Column:
    return F.concat("__base", F.coalesce("__found", F.array().cast("array<struct<rank:int,s:int,e:int>>")))


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 and spans of every row; texts are read once. Base are the fixed
    patterns of BASE; secrets are among the other spans."""
    marked = with_seeds(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    marked = cut(marked.select("doc_id", F.xxhash64("__text").alias("__hash"), "__seeds", "__cands"))
    found = discovered(marked, ["doc_id", "__hash"]).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "__found")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    out = marked.select("doc_id", "__hash", _plain("__seeds").alias("__base")).join(found, same, "left")
    count = lambda rank: F.size(F.filter("__base", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    base = F.filter("__base", lambda x: x["rank"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(_all_spans()).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 20_000) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one.

    Only documents with discovered spans are looked up; they are broadcast where they are few, and joined otherwise.
    A null text stays null. A column n_chars, if any, is set to the new length.
    """
    own = packed(docs, id=F.col(f"`{doc_id}`"), text=F.col(f"`{text}`"))
    marked = with_seeds(own).withColumn("__hash", F.xxhash64("__text"))
    light = cut(marked.select(F.col("id").alias("__id"), F.col("__hash").alias("__h"), "__seeds", "__cands"))
    light = light.where((F.size("__seeds") > 0) | (F.size("__cands") > 0))  # once they are found: else they'd be sought twice
    found = cut_narrow(discovered(light, ["__id", "__h"]))
    few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
    base = marked.withColumn("__base", _plain("__seeds")).drop("__cands", "__seeds")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    both = base.join(F.broadcast(found) if few else found, same, "left")
    order = F.sort_array(F.transform(_all_spans(), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["rank"].alias("rank"))))
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col("__text"), acc["at"] + 1, x["s"] - acc["at"])
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], between, F.get(kind, x["rank"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.length("__text")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    both = both.withColumn("__order", order)
    clean = F.when(F.size("__order") == 0, F.col("text")).otherwise(F.aggregate("__order", start, step, rest))
    both = both.withColumn("__clean", clean)
    made = {text: F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return both.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])
