"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked within a Hamming radius, exactly.

Fingerprints that lie within the radius agree on at least `blocks - radius` of `blocks` bit blocks (pigeonhole), so each
distinct fingerprint is sent to one cell for every choice of that many blocks. In a cell the comparison is tiled:
fingerprints are sorted by population count, tiles are compared by exclusive-or and bit count in numpy, and tile pairs
whose population counts differ beyond the radius are skipped. No pair is lost and none is approximate.

Copies meet before any comparison: equal fingerprints are one row. A cell with more than `tile` fingerprints is split by
hash into sub-tiles, every pair of which is a cell of its own. A large cell gives a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow, packed, text_of
from .components import connected_components

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
SEED, WORDS, RADIUS = 42, 4, 4


def simhash(text: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 text; zero where it has no word."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    n, digest, join = max(1, len(w) - words + 1), xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        h = np.fromiter((digest(join(w[i : i + words]), SEED) for i in range(start, stop)), np.dtype("<u8"), stop - start)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp): the MD5 of the text, and its fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fp = np.fromiter((simhash(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fp.view(np.int64))], names=["doc_id", "digest", "fp"])

    whole = text_of(F.col(f"`{text}`"))
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.md5(whole).alias("digest"), whole.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, digest string, fp long")


def _settle(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of n nodes after joining i to j: the smallest index of each component."""
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        for end in (i, j):
            np.minimum.at(labels, before[end], low)
            np.minimum.at(labels, end, low)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
        if (before == labels).all():
            return labels


def tiled_forest(fp: np.ndarray, radius: int = RADIUS, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (root, member) that connect what is linked among fp, by the tiled exact comparison."""
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order].astype(int)
    labels = np.arange(len(fp))
    for a in range(0, len(fp), tile):
        x = fp[a : a + tile]
        for b in range(a, len(fp), tile):
            if ones[b] - ones[min(a + tile, len(fp)) - 1] > radius:
                break
            near = np.bitwise_count(x[:, None] ^ fp[None, b : b + tile]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            fresh = labels[i] != labels[j]
            if fresh.any():
                labels = _settle(len(fp), i[fresh], j[fresh], labels)
    member = np.nonzero(labels != np.arange(len(fp)))[0]
    return order[labels[member]], order[member]


def _links_of_cells(batches: Iterator[pa.RecordBatch], radius: int, small: int = 16) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        fp = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        sizes = np.asarray(lists.value_lengths()).astype(int)
        cell = np.repeat(np.arange(len(sizes)), sizes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        few = (sizes <= small)[cell]
        f, c = fp[few], cell[few]
        for apart in range(1, small):
            if len(f) <= apart:
                break
            near = (c[:-apart] == c[apart:]) & (np.bitwise_count(f[:-apart] ^ f[apart:]) <= radius)
            found.append((f[:-apart][near], f[apart:][near]))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for k in np.nonzero(sizes > small)[0]:
            own = fp[starts[k] : starts[k + 1]]
            i, j = tiled_forest(own, radius)
            found.append((own[i], own[j]))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _masks(blocks: int, shared: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    whole = [sum(c) for c in combinations(parts, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = RADIUS + 2, tile: int = 4096, broadcast_rows: int = 100_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that connect all that lie within the radius."""
    fp = F.col("fp")
    keys = F.array(*[fp.bitwiseAND(F.lit(m)) for m in _masks(blocks, blocks - radius)])
    banded = distinct.select("fp", F.posexplode(keys).alias("band", "key"))
    hot = cut_narrow(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile))
    n_hot = hot.count()
    if n_hot:
        banded = banded.join(F.broadcast(hot) if n_hot <= broadcast_rows else hot, ["band", "key"], "left")
        parts = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
        banded = banded.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda u: F.struct(F.least("own", u).alias("lo"), F.greatest("own", u).alias("hi")))
        banded = banded.select("fp", "band", "key", F.explode(pairs).alias("cell")).select("fp", "band", "key", "cell.lo", "cell.hi")
    else:
        banded = banded.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    cells = banded.groupBy("band", "key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return cells.mapInArrow(lambda x: _links_of_cells(x, radius), "a long, b long")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable by links.

    Defined results: null and empty texts have fingerprint zero and are linked like others; repeated rows come back
    repeated; a row without doc_id is linked but never names a component (component_id is null where no member has an
    id); an empty table gives an empty result; other columns of docs are not read.
    """
    fps = cut(fingerprints(docs, doc_id, text).drop("digest"))
    distinct = cut_narrow(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = _rooted(distinct, radius)
    least = cut_narrow(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut_narrow(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root): the rows of (fp, first) with the smallest fingerprint of their component."""
    labels = connected_components(near_links(distinct, radius))
    rooted = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    return cut_narrow(rooted.select("fp", "first", F.coalesce("label", "fp").alias("root")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns: the one of smallest doc_id (none counts as largest), then of smallest digest.

    A row gives way to a row of its own component alone, so rows that share a doc_id and are no near-duplicates all stay,
    and rows without a doc_id are treated like others. Of rows equal in doc_id and text the one whose other columns come
    first as JSON stays, so reruns agree.
    """
    key, digest = F.col(f"`{doc_id}`").cast("long"), F.md5(text_of(F.col(f"`{text}`")))
    fps = fingerprints(docs, doc_id, text).select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row"))
    distinct = cut_narrow(fps.groupBy("fp").agg(F.min("row").alias("first")))
    chosen = cut_narrow(_rooted(distinct, radius).groupBy("root").agg(F.min("first").alias("first"))).select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept"))
    named = packed(docs, key=key, digest=digest, rest=F.to_json(F.struct(F.lit(0), *[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(docs.columns) if c not in (doc_id, text)])))
    own = named.join(chosen, named["key"].eqNullSafe(chosen["kept_id"]) & (named["digest"] == chosen["kept"]), "left_semi")
    return own.groupBy("key", "digest").agg(F.min_by("row", "rest").alias("row")).select("row.*")
