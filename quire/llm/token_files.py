"""Flat token files: unsigned little-endian ids, 64-bit document offsets, memory-mapped (or read by ranges) when read.

Documents are dealt into ranges of ascending doc_id. Each partition writes three files: part-N.tokens (the ids, 16 bits
where the vocabulary allows it, else 32), part-N.offsets (one more 64-bit number than documents, from 0) and part-N.ids
(64-bit doc_ids). The manifest has a row a partition; its bases are prefix sums of the partitions' counts, so offset
plus base is a document's place in the whole. Files are written under a name of the attempt and then renamed, so a task
that is run again leaves the same files.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

NO_ID = -(1 << 63)
SOME = 1024  # documents that are read at a time
MARKS = ".,;:!?"
ODD = ("  ", " \n", "\n ", "\n\n")  # white space that isn't single
_KEPT: dict[str, WordMemo] = {}


class Known(dict):
    """The ids of words; a word that isn't there has none for now, and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.missed.append(word)
        return b""


class WordMemo:
    """Encodes whole texts with a byte-level tokenizer of the tokenizers library, one call for each new chunk.

    The tokenizer splits at single spaces and line feeds between other characters, whatever stands around them, so the
    ids of such a chunk (with its space, if one leads) can be kept. Texts of any other form go to the library whole, and
    so do all texts where the file names another way to split or normalise.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splits = made.get("pre_tokenizer") or {}
        self.splits_at_spaces = made.get("normalizer") is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letters = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(letters.values()) + 1, bool)  # ids of tokens that begin with a space
        self.leads[[i for t, i in letters.items() if t.startswith("\u0120")]] = True
        self.known = Known()
        self.marks = dict(zip(MARKS, self._ids(list(MARKS)), strict=True))
        self.feed = self._ids(["\n"])[0]
        self.limit = limit

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_spaced(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it: one call, cut where a token begins with a space."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
        starts = np.flatnonzero(self.leads[ids]) * self.dtype.itemsize
        if len(starts) != len(words):
            return self._ids([" " + w for w in words])
        data = ids.astype(self.dtype).tobytes()
        ends = [*starts[1:].tolist(), len(data)]
        return [data[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]

    def _split(self, text: str) -> list[str] | None:
        """The words of a text: the first after two line feeds, a line's first after one, others bare. None where the text
        has to be encoded whole: white space that isn't single, or isn't a space or line feed, or a special token."""
        if not self.splits_at_spaces or not text or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in ODD):
            return None
        if not text.replace("\n", "").isprintable() or any(s in text for s in self.special):
            return None  # other white space isn't printable
        return ("\n\n" + text.replace("\n", " \n")).split(" ")

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of words as _split gives them; kept as long as there is room."""
        plain = [w for w in new if w[0] != "\n"]
        marked = [w for w in plain if w[-1] in MARKS and w[:-1].isalpha()]  # letters and a mark: two tokens at least
        bare = {m: m[:-1] for m in marked}
        plain = list({*plain}.difference(marked).union(w for w in bare.values() if w not in self.known))
        found = dict(zip(plain, self._ids_spaced(plain), strict=True))
        found.update([(m, (found.get(w) or self.known[w]) + self.marks[m[-1]]) for m, w in bare.items()])
        first = [w for w in new if w[0] == "\n"]
        feed = self.feed
        found.update([(w, i if w[1:2] == "\n" else feed + i) for w, i in zip(first, self._ids([w.lstrip("\n") for w in first]), strict=True)])
        if len(self.known) < self.limit:
            self.known.update(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes. Words that aren't known are encoded in one call for all texts.

        Those that come first are kept, among them the frequent ones; once there is no room left, other words are encoded
        each time. Where that is a third of all words, the texts have changed, and keeping begins anew.
        """
        known, out, whole, late, new, words_seen, words_new = self.known, [b""] * len(texts), [], [], set(), 0, 0
        for k, text in enumerate(texts):
            words = self._split(text)
            if words is None:
                whole.append(k)
                continue
            parts = list(map(known.__getitem__, words))
            words_seen += len(words)
            if known.missed:
                new.update(known.missed)
                words_new += len(known.missed)
                late.append((k, parts, known.missed))
                known.missed = []
            else:
                out[k] = b"".join(parts)
        full = len(known) >= self.limit
        found = self._learn(new)
        for k, parts, missed in late:  # each word is looked up once, and those that were missed once more
            at = -1
            for word in missed:
                at = parts.index(b"", at + 1)
                parts[at] = found[word]
            out[k] = b"".join(parts)
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids
        if full and 3 * words_new > words_seen:
            self.known = Known()
        return out


def _memo(path: str) -> WordMemo:
    if path not in _KEPT:
        _KEPT[path] = WordMemo(path)
    return _KEPT[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text, append end_id, write the files in ascending doc_id order, and return the manifest.

    Defined results: a null text counts as empty (the end id alone); a null doc_id comes first; rows that repeat a
    doc_id stay, ordered by a hash of their texts; an empty table gives an empty manifest. A text of any length is encoded
    whole, one row at a time beside those of its batch.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(tokenizer)
        end = np.array([end_id], memo.dtype).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05d}"
        parts = {k: f"{name}.{k}.{context.taskAttemptId()}" for k in ("tokens", "offsets", "ids")}
        out, docs_done, at = None, 0, 0
        for batch in batches:
            if out is None:
                out = {k: fs.open_output_stream(p) for k, p in parts.items()}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                ids = [b + end for b in memo.encode(some.column("text").to_pylist())]
                ends = at + np.cumsum([len(b) // memo.dtype.itemsize for b in ids])
                out["tokens"].write(b"".join(ids))
                out["offsets"].write(ends.astype("<u8").tobytes())
                out["ids"].write(np.asarray(some.column("doc_id").fill_null(NO_ID)).astype("<i8").tobytes())
                docs_done, at = docs_done + len(ids), int(ends[-1])
        if out is not None:
            for k, p in parts.items():
                out[k].close()
                fs.move(p, f"{name}.{k}")
            row = [[context.partitionId()], [f"{folder}/part-{context.partitionId():05d}"], [memo.dtype.itemsize], [docs_done], [at]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "path", "width", "docs", "tokens"])

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    dealt = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = sorted(dealt.mapInArrow(run, "part int, path string, width int, docs long, tokens long").collect())
    manifest, base_doc, base = [], 0, 0
    for r in rows:
        manifest.append((*r, base_doc, base))
        base_doc, base = base_doc + r["docs"], base + r["tokens"]
    return docs.sparkSession.createDataFrame(manifest, "part int, path string, width int, docs long, tokens long, base_doc long, base long")


def open_numbers(fs: pafs.FileSystem, path: str, dtype: str) -> tuple[int, Callable[[int, int], np.ndarray]]:
    """How many numbers a file holds, and a way to get those from one place up to another: out of a memory map where the
    store is this machine's, else read at their place, so no more than what is asked for comes into memory."""
    width = np.dtype(dtype).itemsize
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            mapped = np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ) if size else b"", dtype)
        return len(mapped), lambda a, b: mapped[a:b]
    file = fs.open_input_file(path)
    return file.size() // width, lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), dtype)


def read_token_files(manifest: DataFrame, checksum: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, and the crc32 of the ids as 32-bit numbers or the ids.

    A task goes through a part's documents, some at a time, by their offsets; it never holds a part.
    """
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            fs, path = pafs.FileSystem.from_uri(row["path"])
            (_, tokens), (_, offsets), (n_docs, ids) = (open_numbers(fs, f"{path}.{k}", t) for k, t in (("tokens", f"<u{row['width']}"), ("offsets", "<u8"), ("ids", "<i8")))
            for first in range(0, n_docs, SOME):
                o = offsets(first, min(first + SOME, n_docs) + 1).astype(np.int64)
                own, some = ids(first, min(first + SOME, n_docs)), tokens(int(o[0]), int(o[-1]))
                wide = some.astype("<u4")
                each = [wide[a:b] for a, b in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if checksum else pa.array(each, pa.list_(pa.int64()))
                names = ["doc_id", "start", "n_tokens", "ids_crc32" if checksum else "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), last], names=names)

    kind = "ids_crc32 long" if checksum else "ids array<long>"
    return manifest.repartitionByRange(max(1, n), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")
