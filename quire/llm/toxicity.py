"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Entries are whole words, or words less up to three last letters, which other endings may follow. Folding maps every
character to one: case, accents, look-alike letters of other scripts, and digits and signs that stand for letters. A hit
counts where no letter of the original stands at either side, unless an exception phrase covers it.
The lexicon is learned from a labelled sample (at most `sample_rows` documents): entries of any length that occur in
clearly more toxic than clean documents, weighted by the log of that ratio; entries given in `extra` are added. A
logistic curve over the weight of the hits by length, fitted on the same sample, makes the score.

Defined results: a null text counts as empty and gets the score of a text without hits; with no labelled rows only
`extra` entries count; a label that is given twice counts once, and a document with two different ones is not learned
from; of rows with equal doc_id one text is learned from, and all are scored; an empty table gives an empty result. Texts
of any length are folded and matched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow, id_remainder, text_of

# A letter and letters of other scripts that look like it; digits and signs that stand for letters. A 1 stands
# for i or l, so l counts as i.
LOOKALIKES = {c: word[0] for word in "aаα bвьβ cсϲ dԁժ eеєε gց hнһհ iіїɩι jјϳ kкκ mм nпηո oоοσօ pрρ qԛգ rг sѕ tтτ uυμս vѵν wѡωԝա xхχ yуγү zᴢζ".split() for c in word[1:]}
SIGNS = dict(zip("0134578@$!l", "oieastbasii", strict=True))
LETTER = re.compile(r"(?:LATIN|SYMBOL).* LETTER (?:[A-Z]{2,} )*([A-Z])(?: WITH .*)?$")
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum", "idiot proof")


class _Fold(dict):
    """One character for each character, worked out once."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()[:1]
        base = LOOKALIKES.get(c) or unicodedata.normalize("NFKD", c)[:1].lower() or c
        if base > "\x7f" and (named := LETTER.search(unicodedata.name(base, ""))):
            base = named[1].lower()  # letters with a stroke, small capitals, letters in boxes
        base = LOOKALIKES.get(base, base)
        out = self[point] = SIGNS.get(base, base)
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(_FOLD)


def entries_of(text: str) -> Counter:
    """How often each entry occurs in a text: its folded words, as `=word`, and, as `^beginning`, what is left of them
    when none to three of their last letters go, if that is three letters or more."""
    out: Counter = Counter()
    for w, times in Counter(text.split()).items():
        a, b = 0, len(w)
        while a < b and not w[a].isalnum():
            a += 1
        while b > a and not w[b - 1].isalnum():
            b -= 1
        if a < b:
            word = fold(w[a:b])
            out["=" + word] += times
            for n in range(max(3, b - a - 3), b - a + 1):
                out["^" + word[:n]] += times
    return out


class Matcher:
    """The automaton of a weighted lexicon and its exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        forms: dict[str, dict[str, float]] = {}
        for entry, value in weights.items():
            own = forms.setdefault(fold(entry[1:]), {})
            own[entry[0]] = max(value, own.get(entry[0], 0.0))
        for form, values in forms.items():
            self.automaton.add_word(form, (len(form), values.get("^", 0.0), values.get("=", 0.0), False))
        for p in map(fold, exceptions):
            self.automaton.add_word(p, (len(p), 0.0, 0.0, True))
        self.any = bool(weights)
        if self.any:
            self.automaton.make_automaton()

    def weight(self, text: str) -> float:
        """The sum, over the words that hit, of their largest weight."""
        if not self.any:
            return 0.0
        hits: dict[int, float] = {}
        safe = []
        for last, (n, start, word, harmless) in self.automaton.iter(fold(text)):
            first = last - n + 1
            if first and text[first - 1].isalpha():
                continue
            whole = last + 1 == len(text) or not text[last + 1].isalpha()
            if harmless and whole:
                safe.append((first, last))
            value = max(start, word) if whole else start
            if value > hits.get(first, 0.0):
                hits[first] = value
        return sum(v for k, v in hits.items() if not any(a <= k <= b for a, b in safe))


def density(weight: float, text: str) -> float:
    """The weight of the hits by length, on a log scale."""
    return math.log1p(100 * weight / (text.count(" ") + text.count("\n") + 20))


def labelled_sample(labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """doc_id and y of at most sample_rows labelled documents that aren't held out (remainder 1 of 3), by a hash of
    doc_id; those with two different labels are left out."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    own = own.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other")
    return own.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def _counted(sample: DataFrame) -> DataFrame:
    """(e, docs, clean, bad, good): in how many toxic and clean documents an entry stands, and how often in each."""
    names = ["docs", "clean", "bad", "good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("y").to_pylist()
            for start in range(0, len(texts), 512):
                docs, counts = [Counter(), Counter()], [Counter(), Counter()]
                for t, y in zip(texts[start : start + 512], labels[start : start + 512], strict=True):
                    own = entries_of(t)
                    counts[y].update(own)
                    docs[y].update(own.keys())
                keys = list(counts[0].keys() | counts[1].keys())
                columns = [pa.array([c[k] for k in keys], pa.int64()) for c in (docs[1], docs[0], counts[1], counts[0])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], names=["e", *names])

    made = sample.mapInArrow(run, "e string, docs long, clean long, bad long, good long")
    return made.groupBy("e").agg(*[F.sum(c).alias(c) for c in names])


def learn_lexicon(sample: DataFrame, ratio: float = 8.0, support: int = 3, chance: float = 0.05) -> dict[str, float]:
    """Weights of words (`=word`) and beginnings of words (`^beginning`), from (text, y) rows.

    An entry's weight is the log of how much oftener it occurs among the words of toxic documents than of clean ones.
    It must stand in `support` toxic documents, and in more of them than chance explains: by Chernoff's bound, fewer than
    `chance` entries in all would pass if labels were dealt at random. So what is needed grows with the log of the number
    of entries, not with the labels. Of nested entries that make up nearly the same occurrences the longest stays; one
    that a shorter entry with more of them covers goes. What comes to the driver is bounded by the sample.
    """
    size = F.regexp_count("text", F.lit(r"[^ \t-\r]+"))
    totals = {r["y"]: r for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(size).alias("words")).collect()}
    if 1 not in totals:
        return {}
    clean, n_clean = (totals[0]["words"], totals[0]["n"]) if 0 in totals else (0, 0)
    counted = cut_narrow(_counted(sample))
    odds = F.col("bad") / max(1, totals[1]["words"]) / ((F.col("good") + 2) / (clean + 2))
    usual = min(0.5, totals[1]["n"] / (totals[1]["n"] + n_clean))
    k, n = F.col("docs"), F.col("docs") + F.col("clean")
    gain = k * F.ln(k / (n * usual)) + F.when(n > k, (n - k) * F.ln((n - k) / (n * (1 - usual)))).otherwise(0.0)
    sure = (k >= support) & (k > n * usual) & (gain >= math.log(max(1, counted.count()) / chance))
    found = {r["e"]: (r["bad"], math.log(r["odds"])) for r in counted.where(sure).withColumn("odds", odds).where(F.col("odds") >= ratio).collect()}
    longer: dict[str, int] = {}  # most toxic occurrences of an entry that extends a beginning
    for e, (bad, _) in found.items():
        for n in range(4, len(e) + (e[0] == "=")):
            start = "^" + e[1:n]
            longer[start] = max(longer.get(start, 0), bad)
    kept: dict[str, float] = {}
    for e in sorted(found, key=len):
        bad, weight = found[e]
        covered = any(found["^" + e[1:n]][0] > bad / 0.95 and found["^" + e[1:n]][1] > weight - 1 for n in range(4, len(e) + (e[0] == "=")) if "^" + e[1:n] in kept)
        if not covered and not (e[0] == "^" and longer.get(e, 0) >= 0.95 * bad):
            kept[e] = weight
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, least: float, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic curve: the slope of a regression of y on x by Newton steps (not negative), and
    the intercept that gives the score `least` where a cut parts the labels with the fewest errors."""
    a, b = 1.0, -2.0
    if not len(y) or y.min() == y.max():
        return a, b
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * np.array([a, b]))
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    a = max(a, 1e-3)
    order = np.argsort(x, kind="stable")
    above = np.concatenate(([0], np.cumsum(np.where(y[order] == 1, 1, -1))))  # errors of a cut, but for a constant
    places = np.flatnonzero(np.diff(x[order], prepend=-1.0, append=x.max() + 1.0) > 1e-12)
    best = places[np.argmin(above[places])]
    low, high = (x[order[best - 1]] if best else x[order[0]] - 1.0), (x[order[best]] if best < len(x) else x.max() + 1.0)
    return a, math.log(least / (1 - least)) - a * float(low + high) / 2


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 12_000, least: float = 0.7, extra: dict[str, float] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. The sample's labels are broadcast: at most sample_rows."""
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    sample = narrow.join(F.broadcast(labelled_sample(labels, label, sample_rows)), "doc_id")
    sample = cut(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"))
    weights = (extra or {}) | learn_lexicon(sample)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(weights)
        for batch in batches:
            x = [density(own.weight(t), t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=[batch.schema.names[0], "x"])

    seen = sample.select("y", "text").mapInArrow(densities, "y int, x double").toPandas()
    slope, middle = fit_curve(seen["x"].to_numpy(float), seen["y"].to_numpy(float), least)
    made = narrow.mapInArrow(densities, "doc_id long, x double")
    score = 1 / (1 + F.exp(-(F.col("x") * slope + middle)))
    made = made.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"))
    return made.withColumn("predicted", (F.col("score") >= least).cast("int"))
