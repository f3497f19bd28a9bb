"""BPE encoding and decoding with word ends: frequent words come from a transducer, unseen ones are merged exactly.

The corpus is counted in Spark; its most frequent words (at most `lexicon_words`) and their ids are compiled into a
minimal acyclic transducer, whose file Spark hands to every executor, where it is memory-mapped. A word that isn't in
it is merged pair by pair, lowest rank first. Ids never depend on the lexicon, only the speed does.

Defined results: a null text counts as empty (no ids, an empty decoded text); repeated rows come back repeated; an empty
table gives an empty result. Very long words are merged with a heap, in near-linear time.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Transducer, compile_words
from .common import fresh_folder, text_of

# The pieces a text is cut into, and the white space between them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD_SPACE = "[\x1c-\x1f]"  # the str methods take these for white space, the pieces don't
BITS = 17
MASK, NONE = (1 << BITS) - 1, 1 << 62
LONG = 64  # longer pieces are merged with a heap, longer words are not kept
_KEPT: dict[str, WordCoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def _refuse_other_kinds(made: dict) -> None:
    """Only files of the kind that this module reproduces: NFC, white space folded, small letters, cut into PIECES, bytes as
    letters, word ends marked, no decoder."""
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    sound = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
    sound = sound and cuts[0]["pattern"].get("Regex") == PIECES and not cuts[1].get("use_regex") and not cuts[1].get("add_prefix_space")
    if not sound or made.get("decoder") or made["model"].get("type") != "BPE" or not made["model"].get("end_of_word_suffix"):
        raise ValueError("the tokenizer file is of another kind")


class WordCoder:
    """One tokenizer file, and the ids of the words seen so far."""

    def __init__(self, path: str, lexicon: Transducer | None = None, limit: int = 500_000):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        _refuse_other_kinds(made)
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # a pair of ids, as one number, to its rank and new id, as one number
        self.merges = {self.vocab[a] << BITS | self.vocab[b]: rank << BITS | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        order = sorted(self.merges)
        self.pairs = np.array([*order, 1 << 62], np.int64)  # the same, to look many up at once; the last one is never met
        self.results = np.array([*map(self.merges.__getitem__, order), NONE], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.pieces = regex.compile(PIECES)
        self.pieces_and_ends = regex.compile(PIECES + r"|\n")
        self.odd = regex.compile(ODD_SPACE)
        self.space = regex.compile(r"\s+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = dict.fromkeys(range(max(self.names) + 1), "") | self.names
        self.tokens = pa.array([names[i] for i in range(len(names))], pa.string())
        self.lexicon, self.limit = lexicon, limit
        # words and pieces of late to their ids as bytes, and those of the time before
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, by merging."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        return self._merge_short(ids) if len(ids) < LONG else self._merge_long(ids)

    def merge_many(self, pieces: list[bytes], together: int = 4096) -> list[bytes]:
        """The ids of many pieces, each as 32-bit numbers; pieces of like length are merged side by side."""
        out = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        while order and len(pieces[order[-1]]) >= LONG:
            out[order[-1]] = np.array(self.merge(pieces[order[-1]]), "<i4").tobytes()
            order.pop()
        for start in range(0, len(order), together):
            some = order[start : start + together]
            for i, ids in zip(some, self._merge_rows([pieces[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """A row for each piece: in each round every row merges the pair of its lowest rank, the leftmost on a tie. A row's
        last slot holds MASK, which no pair has."""
        lengths = np.array([*map(len, pieces)])
        stride = int(lengths.max()) + 1
        place = np.arange(stride)
        ids = np.full((len(pieces), stride), MASK, np.int64)
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        ids[place < lengths[:, None]] = self.inner_ids[letters]
        ids[np.arange(len(pieces)), lengths - 1] = self.last_ids[letters[np.cumsum(lengths) - 1]]
        best = np.full(ids.shape, NONE, np.int64)  # what the pair that begins at a slot merges to
        best[:, :-1] = self._look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, stride - 1)
        base = np.arange(len(pieces)) * stride
        after = base[:, None] + np.append(place[1:], stride - 1)
        before = base[:, None] + np.append(stride - 1, place[:-1])
        ids, after, before, flat = ids.ravel(), after.ravel(), before.ravel(), best.ravel()
        live = np.arange(len(pieces))
        while len(live):
            at = base[live] + best[live].argmin(axis=1)
            found = flat[at]
            more = found != NONE
            live, at, found = live[more], at[more], found[more]
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], flat[gone] = found & MASK, -1, NONE
            after[at], before[right] = right, at
            flat[at] = self._look_up(ids[at], ids[right])
            flat[left] = self._look_up(ids[left], ids[at])
        kept = (ids >= 0) & (ids != MASK)
        ends = np.cumsum(kept.reshape(-1, stride).sum(axis=1) * 4).tolist()
        data = ids[kept].astype("<i4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << BITS | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.results[at], NONE)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << BITS | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [best & MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << BITS | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << BITS | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m & MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := get(ids[k] << BITS | ids[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def _units(self, text: str) -> list[str]:
        """The text without white space: words, and special tokens by themselves."""
        if self.cut is not None and any(s in text for s in self.special):
            return [u for p in self.cut.split(text) for u in ([p] if p in self.special else self._units(p))]
        return [u for u in self.space.split(text) if u] if self.odd.search(text) else text.split()

    def _pieces(self, words: list[str]) -> list[str]:
        """The pieces of all words, with a line feed, which no word holds, after each word."""
        text = "\n".join([*words, ""])
        return self.pieces_and_ends.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _learn(self, new: set[str]) -> None:
        """Add the ids of words that are not in `words`: from the time before, from the lexicon, or merged."""
        words, old, fresh = self.words, self.old_words, []
        for w in new:
            if w in old:
                words[w] = old[w]
            elif w in self.special:
                words[w] = np.array([self.special[w]], "<i4").tobytes()
            else:
                fresh.append(w)
        pieces = self._pieces(fresh)
        known, unseen = self.known, []
        for p in set(pieces).difference(known, ["\n"]):
            if (ids := self.old_known.get(p)) is not None:
                known[p] = ids
            elif self.lexicon is not None and (listed := self.lexicon.get(p.encode())) is not None:
                known[p] = np.array(listed, "<i4").tobytes()
            else:
                unseen.append(p)
        known.update(zip(unseen, self.merge_many([p.encode() for p in unseen]), strict=True))
        start = 0
        for w in fresh:
            end = pieces.index("\n", start)
            words[w] = known[pieces[start]] if end == start + 1 else b"".join(map(known.__getitem__, pieces[start:end]))
            start = end + 1
        for long in [p for p in unseen if len(p) > LONG]:
            del known[long]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as 32-bit numbers."""
        if len(self.words) > self.limit // 4:
            self.old_words, self.words = self.words, {}
        if len(self.known) > self.limit // 4:
            self.old_known, self.known = self.known, {}
        units = [self._units(t) for t in texts]
        new: set[str] = set()
        for u in units:
            new.update(set(u).difference(self.words))
        self._learn(new)
        out = [b"".join(map(self.words.__getitem__, u)) for u in units]
        for long in [w for w in new if len(w) > LONG]:  # they seldom come again
            del self.words[long]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<i4")

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of every list, special ones too, joined by spaces, as the file names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values)), " ")


def frequent_words(docs: DataFrame, text: str = "text", lexicon_words: int = 50_000, longest: int = 32) -> list[str]:
    """The most frequent runs of letters over all texts, in lower case; at most lexicon_words come to the driver."""
    words = docs.select(F.explode(F.split(F.lower(text_of(F.col(f"`{text}`"))), r"[^\p{L}]+")).alias("w"))
    # kept in memory or on the executors' disks for the two looks below; lost blocks are counted again
    counts = words.where(F.length("w").between(1, longest)).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").persist()
    # the least count that few enough words reach, from a histogram of counts in eighths of an octave
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = lexicon_words, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    found = [] if least is None else [r["w"] for r in counts.where(step >= least).select("w").collect()]
    counts.unpersist()
    return found


def lexicon_file(words: list[str], tokenizer: str) -> bytes:
    """Frequent words and their ids, compiled. Words that normalisation would change or cut are left out."""
    coder = WordCoder(tokenizer)
    own = {w for w in words if coder.pieces.findall(unicodedata.normalize("NFC", w).lower()) == [w]}
    ascending = sorted(w.encode() for w in own)
    return compile_words(zip(ascending, (np.frombuffer(ids, "<i4").tolist() for ids in coder.merge_many(ascending)), strict=True))


def _coder(tokenizer: str, lexicon: str) -> WordCoder:
    key = f"{tokenizer} {lexicon}"
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordCoder(tokenizer, Transducer(SparkFiles.get(lexicon)))
    return _KEPT[key]


def _slices(sizes: np.ndarray, rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs with at most `rows` rows and `most_bytes` bytes, or of one longer row."""
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and (k - start == rows or held + size > most_bytes):
            yield start, k - start
            start, held = k, 0
        held += size
    if len(sizes):
        yield start, len(sizes) - start


def encode(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", lexicon_words: int = 50_000, rows: int = 512, most_bytes: int = 1 << 22
) -> DataFrame:
    """doc_id, ids and decoded (the text that the ids stand for) of every row. A task holds `rows` rows and `most_bytes`
    bytes of texts at a time, or one longer text."""
    spark = docs.sparkSession
    data = lexicon_file(frequent_words(docs, text, lexicon_words), tokenizer)
    folder = fresh_folder(spark, "lexicon")  # shared; Spark copies the file to every executor from there
    name = f"{folder.rpartition('/')[2]}.bin"  # a session takes each file name once
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(data)
    spark.sparkContext.addFile(f"{folder}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer, name)
        for batch in batches:
            for start, count in _slices(pc.binary_length(batch.column("text")).to_numpy(), rows, most_bytes):
                some = batch.slice(start, count)
                ids = coder.encode_many(some.column("text").to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, coder.decode_many(lists)], names=["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
