"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. The votes of all documents are counted
by pattern: at most 3 ** len(RULES) rows, whatever the input. Bad documents are bad in different ways, in which different
rules see them, so the latent class is good or one of a few kinds of defect. Expectation-maximisation over the table
estimates the share of each class and how often each rule's votes are bad on it; a document's posterior probability of
being good takes the place of passing every rule. An abstention is no evidence. The start counts as a few
pseudo-documents, so votes decide as soon as there are more; a bad vote never speaks for a document.

Defined results: a null or empty text has no words and fails the base rule; an empty table gives an empty result with
the starting parameters; repeated rows are judged alike and each counts; other columns are kept, and those named as an
output give way. Very long texts are judged whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, fresh_folder, packed, text_of, with_columns_over, word_array

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

RULES = ["length", "word_size", "symbols", "plain", "lines", "repeats", "capitals", "variety"]
# The latent classes, and the rules that are likely to see a kind of defect when fitting starts.
CLASSES = {"good": (), "noise": ("word_size", "symbols", "plain", "capitals"), "repetition": ("lines", "repeats", "variety"), "size": ("length",)}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_plain_words"]
# A plain word holds a letter and no symbol (mathematical, currency and the like, and those of SYMBOLS).
PLAIN_WORD = r"(?<![^ \t-\r])[^ \t-\r\p{S}#*$%&|<>\p{L}]*+\p{L}[^ \t-\r\p{S}#*$%&|<>]*+(?![^ \t-\r])"


def _minus(column: str | Column, less: int) -> Column:
    return F.greatest(F.size(column) - less, F.lit(0))


def _pair_hashes(array: str, apart: int) -> Column:
    """Hash each element with the one `apart` places later."""
    n = _minus(array, apart)
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def document_statistics(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """Add the columns of STATISTICS (with the prefix) to every row, from the whole text.

    Windows of eight words are compared by a 64-bit hash of their words' hashes, built in three doublings; only a
    document in which some window occurs twice has its windows sorted.
    """
    c = lambda name: f"{prefix}{name}"
    base = docs.withColumn(c("text"), text_of(F.col(f"`{text}`")))
    base = base.withColumn(c("words"), word_array(F.col(c("text"))))
    base = base.withColumn(c("lines"), F.filter(F.split(c("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    base = base.withColumn(c("h1"), F.transform(c("words"), lambda w: F.xxhash64(w)))
    t = F.col(c("text"))
    base = base.withColumns(
        {
            c("n_words"): F.size(c("words")).cast("long"),
            c("word_chars"): F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
            c("n_symbols"): (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            c("n_capitals"): (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
            c("n_plain_words"): F.regexp_count(t, F.lit(PLAIN_WORD)).cast("long"),
            c("n_lines"): F.size(c("lines")).cast("long"),
            c("n_dup_lines"): (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            c("n_distinct_words"): F.size(F.array_distinct(c("h1"))).cast("long"),
            c("h2"): _pair_hashes(c("h1"), 1),
        }
    ).drop(c("text"), c("words"), c("lines"))
    base = base.withColumn(c("h4"), _pair_hashes(c("h2"), 2)).drop(c("h1"), c("h2"))
    base = base.withColumn(c("h8"), _pair_hashes(c("h4"), 4)).drop(c("h4"))
    windows = F.transform(c("h8"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(c("h8"))) < F.size(c("h8"))
    base = base.withColumn(c("sorted"), F.when(some, F.sort_array(windows))).drop(c("h8"))
    s = F.col(c("sorted"))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(s, i - 1), F.get(s, i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    base = base.withColumn(c("at"), F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))).drop(c("sorted"))
    n = _minus(c("at"), 1)
    steps = F.zip_with(F.slice(c("at"), F.lit(1), n), F.slice(c("at"), F.lit(2), n), lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.aggregate(steps, F.lit(8), lambda acc, x: acc + x)
    return base.withColumn(c("n_repeat_words"), F.when(F.size(c("at")) > 0, covered).otherwise(0).cast("long")).drop(c("at"))


def _rules(prefix: str = "__q_") -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes bad and when it votes good; otherwise it abstains. Bad wins."""
    c = lambda name: F.col(f"{prefix}{name}")
    words = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    mean = c("word_chars") / words
    distinct = F.greatest(c("n_distinct_words"), F.lit(1))  # grows as a power of the words, so logarithms are compared
    return {
        "length": (c("n_words") < 20, c("n_words") >= 40),
        "word_size": ((mean < 2) | (mean > 14), mean.between(3, 10)),
        "symbols": (c("n_symbols") * 10 > words, c("n_symbols") * 50 <= words),
        "plain": (c("n_plain_words") * 5 < words * 4, c("n_plain_words") * 10 >= words * 9),
        "lines": (c("n_dup_lines") * 2 > lines, (c("n_dup_lines") == 0) & (c("n_lines") > 2)),
        "repeats": (c("n_repeat_words") * 10 > words * 3, c("n_repeat_words") * 20 <= words),
        "capitals": (c("n_capitals") * 10 > chars * 4, c("n_capitals") * 20 <= chars * 3),
        "variety": (F.log(distinct) < 0.7 * F.log(words), F.log(distinct) > 0.85 * F.log(words)),
    }


def with_votes(stats: DataFrame, prefix: str = "__q_") -> DataFrame:
    return stats.withColumns({f"{prefix}v_{name}": F.when(bad, -1).when(good, 1).otherwise(0) for name, (bad, good) in _rules(prefix).items()})


def _start(name: str) -> dict[str, float]:
    return {rule: 0.05 if name == "good" else 0.6 if rule in CLASSES[name] else 0.1 for rule in RULES}


@dataclass
class RuleModel:
    """The share of each class, and the share of each rule's votes on documents of that class that are bad."""

    shares: dict[str, float] = field(default_factory=lambda: {name: 0.7 if name == "good" else 0.3 / (len(CLASSES) - 1) for name in CLASSES})
    bad: dict[str, dict[str, float]] = field(default_factory=lambda: {name: _start(name) for name in CLASSES})

    def odds(self, prefix: str = "__q_") -> dict[str, Column]:
        """How many times likelier each class is than good, given a document's votes."""
        out = {}
        for name in CLASSES:
            log, start = F.lit(0.0), math.log(self.shares[name] / self.shares["good"])
            for rule in RULES:
                good, here = self.bad["good"][rule], max(self.bad[name][rule], self.bad["good"][rule])
                # the log odds of a bad vote, an abstention and a good vote; looked up, so that rounds share their code
                values = F.array(*[F.lit(start + x) for x in (math.log(here / good), 0.0, math.log((1 - here) / (1 - good)))])
                log, start = log + F.get(values, F.col(f"{prefix}v_{rule}") + 1), 0.0
            out[name] = F.exp(log)
        return out

    def posterior(self, prefix: str = "__q_") -> Column:
        """The probability that a document is good, given its votes."""
        return 1 / sum(self.odds(prefix).values(), F.lit(0.0))


def fit(voted: DataFrame, prefix: str = "__q_", rounds: int = 400, pseudo: float = 4.0, near: float = 5e-4) -> RuleModel:
    """Estimate the classes' shares and the rules' accuracies from the votes of all documents.

    Spark counts the documents of each vote pattern. That table has 3 ** len(RULES) rows at most, whatever the input, so it
    comes to the driver once and the rounds are arithmetic there. They end when no share moves by more than `near`. The
    start counts as `pseudo` documents, and as so many votes of each rule in each class, so that no rate is 0 or 1; beyond
    that the documents decide.
    """
    votes = [f"{prefix}v_{rule}" for rule in RULES]
    patterns = np.array(voted.groupBy(*votes).agg(F.count("*").alias("n")).collect(), float).reshape(-1, len(RULES) + 1)
    model = start = RuleModel()
    if not len(patterns):
        return model
    vote, n = patterns[:, :-1], patterns[:, -1]
    bad, good = (vote == -1).astype(float), (vote == 1).astype(float)
    table = lambda m: (np.array([m.shares[c] for c in CLASSES]), np.array([[m.bad[c][r] for r in RULES] for c in CLASSES]))
    shares, rates = first_shares, first_rates = table(start)
    for _ in range(rounds):
        seen = np.maximum(rates, rates[0])  # a bad vote never speaks for a document
        log = np.log(shares) + bad @ np.log(seen).T + good @ np.log1p(-seen).T
        part = np.exp(log - log.max(axis=1, keepdims=True))
        part *= (n / part.sum(axis=1))[:, None]
        old, shares = shares, (part.sum(axis=0) + pseudo * first_shares) / (n.sum() + pseudo)
        rates = (part.T @ bad + pseudo * first_rates) / (part.T @ (bad + good) + pseudo)
        if np.abs(old - shares).max() < near:
            break
    return RuleModel(dict(zip(CLASSES, shares.tolist(), strict=True)), {c: dict(zip(RULES, row, strict=True)) for c, row in zip(CLASSES, rates.tolist(), strict=True)})


def judge(voted: DataFrame, model: RuleModel, prefix: str = "__q_", least: float = 0.5) -> DataFrame:
    """Replace the statistics and votes by n_words, the base columns, base_failed, p_good and kept."""
    c = lambda name: F.col(f"{prefix}{name}")
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    out = {name: c(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out |= {"base_failed": failed, "p_good": model.posterior(prefix)}
    out |= {"kept": ~failed & (model.posterior(prefix) >= least)}
    judged = with_columns_over(voted, out)
    return judged.drop(*[x for x in judged.columns if x.startswith(prefix)])


def rule_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, p_good and kept of every document; texts are read once."""
    stats = document_statistics(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    voted = cut(with_votes(stats.drop("text")))
    return judge(voted, fit(voted))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the rules keep.

    Statistics are worked out once: rows are written with their votes to the shared folder, and the model that is fitted
    on the votes filters them as they are read again.
    """
    c = lambda name: F.col(f"__q_{name}")
    voted = with_votes(document_statistics(packed(docs, text=F.col(f"`{text}`"))))
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    folder = fresh_folder(docs.sparkSession, "rules")
    voted.select("row", failed.alias("__q_failed"), *[f"__q_v_{rule}" for rule in RULES]).write.parquet(folder)
    written = docs.sparkSession.read.parquet(folder)
    return written.where(~c("failed") & (fit(written).posterior() >= 0.5)).select("row.*")
