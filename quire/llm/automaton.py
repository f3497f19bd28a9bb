"""A minimal acyclic transducer from words to lists of ids, in one file that is memory-mapped.

Words with the same endings share states. Every edge holds how many words come before it, so a walk adds up to the
word's rank, and the rank finds the ids. Bytes label the edges; a state's labels stand together and are searched in C.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np

SECTIONS = ("first", "targets", "skips", "offsets", "ids", "final", "labels")
HEAD = struct.Struct("<7Q")


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file's bytes, for distinct words in ascending order."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) of the word before, not yet minimised
    before = b""
    offsets, ids = [0], []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            state, label = path.pop()
            child = edges[state][label]
            key = (final[child], tuple(edges[child].items()))
            known = register.setdefault(key, child)
            edges[state][label] = known

    for word, out in words:
        if word <= before and (before or offsets[1:]):
            raise ValueError("words must ascend")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for label in word[same:]:
            edges.append({})
            final.append(False)
            edges[state][label] = len(edges) - 1
            path.append((state, label))
            state = len(edges) - 1
        final[state] = True
        before = word
        ids.extend(out)
        offsets.append(len(ids))
    close(0)

    order, number, stack = [], {}, [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(edges[s].values())
    words_below: dict[int, int] = {}
    pending = [(0, False)]
    while pending:
        s, ready = pending.pop()
        if s in words_below:
            continue
        if ready:
            words_below[s] = final[s] + sum(words_below[t] for t in edges[s].values())
        else:
            pending.append((s, True))
            pending.extend((t, False) for t in edges[s].values())
    first, targets, skips, labels = [0], [], [], bytearray()
    for s in order:
        skip = int(final[s])
        for label, t in edges[s].items():  # words ascend, so labels do
            labels.append(label)
            targets.append(number[t])
            skips.append(skip)
            skip += words_below[t]
        first.append(len(targets))
    made = {"first": first, "targets": targets, "skips": skips, "offsets": offsets, "ids": ids}
    data = [np.array(made[k], "<u4").tobytes() for k in SECTIONS[:5]] + [bytes(final[s] for s in order), bytes(labels)]
    return HEAD.pack(*map(len, data)) + b"".join(data)


class Transducer:
    """Looks words up in a compiled file, or in its bytes."""

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as f:
                self.data = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        else:
            self.data = source
        at, view = HEAD.size, memoryview(self.data)
        parts = {}
        for name, size in zip(SECTIONS, HEAD.unpack(self.data[: HEAD.size]), strict=True):
            parts[name] = view[at : at + size]
            self.labels_at = at
            at += size
        self.first, self.targets, self.skips, self.offsets, self.ids = (parts[k].cast("I") for k in SECTIONS[:5])
        self.final = parts["final"]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it isn't there."""
        state = rank = 0
        first, at, find = self.first, self.labels_at, self.data.find
        for k in range(len(word)):
            edge = find(word[k : k + 1], at + first[state], at + first[state + 1]) - at
            if edge < 0:
                return None
            rank += self.skips[edge]
            state = self.targets[edge]
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist() if self.final[state] else None
