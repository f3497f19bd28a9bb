"""Importance resampling towards a target: draw the documents whose words look most like those of a target corpus.

Features are the runs of 1 to `max_run` consecutive words, hashed into buckets. The work is an external sort-count: each
document's buckets are packed as unsigned 16-bit integers, many documents to a row with the offsets between them, and
written out once. Counting sorts a row's stream and takes its run lengths; weighing gathers the gains of the stream's
buckets and adds them up between the offsets (np.add.reduceat). What Spark shuffles is one count a bucket and task, and one
narrow row a document; what the driver sees is one count a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_narrow, drop_folder, fresh_folder
from .order import running_before

# A-Z to lower case; what is no ASCII letter or digit and no byte of a longer character separates words.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
PACKED = "ids array<bigint>, words array<bigint>, offsets binary, stream binary"


class _Buckets(dict):
    """Bucket of a feature; those of the features seen first are kept, a bounded number."""

    def __init__(self, buckets: int, kept: int = 1 << 18):
        super().__init__()
        self.buckets, self.kept = buckets, kept

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(self) < self.kept:
            self[feature] = bucket
        return bucket


def _blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a folded text, in lists of bounded length."""
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def bucket_stream(text: bytes, max_run: int, known: _Buckets) -> tuple[int, list[np.ndarray]]:
    """The number of words of a UTF-8 text, and the buckets of all its features, in pieces."""
    n_words, found, before = 0, [], []
    for words in _blocks(text.translate(FOLD)):
        n_words += len(words)
        for run in range(1, max_run + 1):
            own = before[len(before) - (run - 1) :] + words if run > 1 else words
            features = own if run == 1 else [b" ".join(own[i : i + run]) for i in range(len(own) - run + 1)]
            found.append(np.fromiter(map(known.__getitem__, features), "<u2", len(features)))
        before = (before + words)[-(max_run - 1) :] if max_run > 1 else []
    return n_words, found


def _row(ids: list[int | None], words: list[int], ends: list[int], pieces: list[np.ndarray]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    offsets, stream = np.array(ends, "<i8").tobytes(), b"".join(p.tobytes() for p in pieces)
    return pa.RecordBatch.from_arrays([pa.array([ids], longs), pa.array([words], longs), pa.array([offsets]), pa.array([stream])], names=["ids", "words", "offsets", "stream"])


def packed_buckets(docs: DataFrame, doc_id: Column, text: Column, max_run: int, buckets: int, row_bytes: int = 1 << 22) -> DataFrame:
    """Rows (ids, words, offsets, stream): the ids of several documents, their numbers of words, and their buckets; those of
    document k stand in the stream from offsets[k] to offsets[k + 1]."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit into 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            ids, words, ends, pieces, size = [], [], [0], [], 0
            for key, value in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                n_words, own = bucket_stream(value.as_py() or b"", max_run, known)
                pieces += own
                size += sum(map(len, own))
                ids.append(key.as_py())
                words.append(n_words)
                ends.append(size)
                if 2 * size >= row_bytes:
                    yield _row(ids, words, ends, pieces)
                    ids, words, ends, pieces, size = [], [], [0], [], 0
            if ids:
                yield _row(ids, words, ends, pieces)

    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, PACKED)


def bucket_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the features in packed: streams are sorted and run-length encoded, a task gives one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                if len(ordered):
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1))
                    counts[ordered[starts]] += np.diff(np.append(starts, len(ordered)))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket from counts (bucket, n): 1000 times the log of how much likelier it is in the target, both
    smoothed by one, rounded down. One number a bucket comes to the driver from each side."""
    s, t = (dict(map(tuple, side.select("bucket", "n").collect())) for side in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t.get(b, 0) + 1) * (all_s + buckets)) / ((s.get(b, 0) + 1) * (all_t + buckets))))
    return np.array([gain(b) for b in range(buckets)], np.int64)


def document_weights(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features, 0 where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*(batch.column(c) for c in ("ids", "words", "offsets", "stream")), strict=True):
                ends = np.frombuffer(offsets.as_buffer(), "<i8")
                there, weight = ends[1:] > ends[:-1], np.zeros(len(ends) - 1, np.int64)
                if there.any():  # reduceat gives an empty segment the element that follows it
                    weight[there] = np.add.reduceat(gains[np.frombuffer(stream.as_buffer(), "<u2")], ends[:-1][there])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(np.diff(ends)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    max_run: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is null where a document isn't drawn.

    score adds Gumbel noise from a hash of seed and doc_id to the weight, so the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Of the N documents of at least min_words words, N * percent // 100 are
    drawn. Words are runs of ASCII letters, digits and other characters beyond ASCII, A-Z in lower case.

    Defined results: a null or empty text has no features, weight 0, and isn't drawn where min_words is over 0; a row
    without doc_id has the noise of the empty id and comes last among ties; rows that repeat an id share its noise and are
    all ranked; an empty target gives every bucket the same chance; an empty table gives no rows; other columns of docs and
    target are not read. A text is packed in pieces of about a million characters, whatever its length.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "buckets")
    packed_buckets(docs, F.col(f"`{doc_id}`"), F.col(f"`{text}`"), max_run, buckets).write.parquet(folder)
    packed = spark.read.schema(PACKED).parquet(folder)
    wanted = bucket_counts(packed_buckets(target, F.lit(None), F.col(f"`{target_text}`"), max_run, buckets), buckets)
    gains = bucket_gains(bucket_counts(packed, buckets), wanted, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = document_weights(packed, gains).withColumns({"score": F.col("weight") + gumbel, "ranked": F.col("n_words") >= min_words})
    scored = cut_narrow(scored)
    drop_folder(spark, folder)
    n_drawn = scored.where("ranked").count() * percent // 100
    order = [F.col("ranked").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    placed = running_before(scored, order, F.lit(1), "before")
    rank = F.when(F.col("ranked") & (F.col("before") < n_drawn), F.col("before") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
