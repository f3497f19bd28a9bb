"""Language by string kernels: blended-spectrum presence kernels, Nystrom landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the mean over n of |X_n & Y_n| / sqrt(|X_n| |Y_n|), where X_n is the set of a text's n-grams of
folded letters (other characters are a single space). Landmark texts give the Nystrom features, ridge regression on those
gives a weight for each landmark and language. As the kernel is linear in presence, the product
(presence x landmarks) x weights is evaluated as presence x (landmarks x weights), for batches of whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled rows every text is `und`;
of languages with equal outputs the first by name is predicted; repeated rows come back repeated; a very long text is one
set of n-grams like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_narrow, id_remainder

SPECTRUM = (1, 2, 3)
SPACE = 32


def _fold_table() -> np.ndarray:
    table = np.full(1 << 16, SPACE, np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0]) & 0xFFFF
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> list[np.ndarray] | None:
    """The distinct n-grams of a text for each n, as sorted numbers; None where it has no letter."""
    if not _TABLE:
        _TABLE.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points > 0xFFFF
    c = _TABLE[0][np.where(high, SPACE, points)]
    if high.any():
        letters = np.array([chr(p).isalpha() for p in points[high].tolist()])
        c[high] = np.where(letters, points[high] & 0xFFFF, SPACE)
    if not (c != SPACE).any():
        return None
    c = c[np.concatenate(([True], (c[1:] != SPACE) | (c[:-1] != SPACE)))]
    c = np.concatenate(([SPACE], c, [SPACE])).astype(np.uint64)
    out = []
    for n in SPECTRUM:
        code = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(16)) | c[k : len(c) - n + 1 + k]
        out.append(np.unique(code))
    return out


@dataclass
class KernelModel:
    languages: list[str]
    known: np.ndarray  # the landmarks' n-grams, sorted
    weights: np.ndarray  # a row for each of them, a column for each language

    def outputs(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """A row of ridge outputs for each text's n-grams."""
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(SPECTRUM)):
            codes = [t[k] for t in texts]
            sizes = np.array([len(c) for c in codes])
            flat = np.concatenate(codes)
            at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
            found = self.known[at] == flat
            row = np.repeat(np.arange(len(texts)), sizes)[found]
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(row, self.weights[at[found], j], len(texts)) / np.sqrt(sizes) / len(SPECTRUM)
        return out


def fit(texts: list[str], languages: list[str], landmarks: int = 160, ridge: float = 1e-3) -> KernelModel | None:
    """Fit on labelled texts; the first `landmarks` of them, in turn from each language, are the landmarks, and one of
    each language at least."""
    pairs = [(g, y) for t, y in zip(texts, languages, strict=True) if (g := grams(t)) is not None]
    names = sorted({y for _, y in pairs})
    if not names:
        return None
    by_name = {n: [k for k, (_, y) in enumerate(pairs) if y == n] for n in names}
    turns = [by_name[n][k] for k in range(max(map(len, by_name.values()))) for n in names if k < len(by_name[n])]
    marks = turns[: max(landmarks, len(names))]
    known = np.unique(np.concatenate([g for k in marks for g in pairs[k][0]]))
    presence = np.zeros((len(known), len(marks)))
    for j, k in enumerate(marks):
        for g in pairs[k][0]:
            presence[np.searchsorted(known, g), j] = 1 / np.sqrt(len(g))
    kernel = KernelModel(["-"] * len(marks), known, presence).outputs([g for g, _ in pairs])
    own = kernel[marks]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-8 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ nystrom
    target = np.array([[1.0 if y == n else -1.0 for n in names] for _, y in pairs])
    gram = features.T @ features + ridge * len(pairs) * np.eye(features.shape[1])
    weights = nystrom @ np.linalg.solve(gram, features.T @ target)
    return KernelModel(names, known, presence @ weights)


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int, sample_rows: int, sample_bytes: int, broadcast_rows: int = 10_000) -> list:
    """Labelled rows of every language, by a hash of doc_id: at most per_language of each, about sample_rows and
    sample_bytes in all, dealt equally, but one row of each language at least."""
    rows = docs.where((id_remainder(F.col(f"`{doc_id}`"), 4) != 2) & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"))
    counts = cut_narrow(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    if not languages:
        return []
    each, room = max(1, min(per_language, sample_rows // languages)), sample_bytes // languages
    # a share of each language somewhat above what is wanted, then exactly as many by rank: no language is gathered whole
    unit = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    near = rows.join(F.broadcast(counts) if languages <= broadcast_rows else counts, "lang").where(unit * F.col("n") < 2.0 * each + 20)
    w = Window.partitionBy("lang").orderBy("h", "text")
    used = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = near.select("lang", "text", F.row_number().over(w).alias("rank"), used.alias("used"))
    return ranked.where((F.col("rank") == 1) | ((F.col("rank") <= each) & (F.col("used") <= room))).orderBy("lang", "rank").select("lang", "text").collect()


def predict_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250, sample_rows: int = 50_000, sample_bytes: int = 64_000_000, rows: int = 128
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Predictions see the text alone."""
    sample = labelled_sample(docs, doc_id, text, lang, per_language, sample_rows, sample_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["lang"] for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                some = batch.slice(start, rows)
                found = [grams(t) if t is not None and own else None for t in some.column("text").to_pylist()]
                named, score = np.full(len(found), "und", object), np.zeros(len(found))
                has = [k for k, g in enumerate(found) if g is not None]
                if has:
                    share = np.clip((own.outputs([found[k] for k in has]) + 1) / 2, 1e-6, 1)
                    best = share.argmax(axis=1)
                    named[has] = np.array(own.languages, object)[best]
                    score[has] = share.max(axis=1) / share.sum(axis=1)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(named.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    made = narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
