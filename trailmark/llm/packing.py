"""Packing by sum of squares, online.

Each input partition packs its own documents.  Whole windows are cut off a document first; what is left of it,
s tokens, goes to the fill level l for which the sum of squared counts of partially filled windows grows least
(a level array holds the counts; a new window is level 0, a window that becomes full leaves the array).  Windows
still open at the end, or when more than ``max_open`` are, are closed by cutting: the emptiest are poured into
the gaps of the fullest.  The one window a partition may have left is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trailmark.llm.common import id_texts, trimmed

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LAST = (1).to_bytes(4, "little")  # the id that ends a document
ARROW = pa.schema([(name.split()[0], pa.int64()) for name in SCHEMA.split(", ")])


class WordCodec:
    """Token ids of whole texts, equal to the tokenizer's own, with a cache of words.

    The cache applies to texts of plain Latin script, for which normalising and splitting are known to agree
    with the tokenizer's; any other text, and any that may hold a special token, goes to the tokenizer itself.
    """

    def __init__(self, path: str, words: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.words = words
        latin = [chr(c) for c in range(0x250)]
        letters = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "N")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t\n\r {letters}{numbers}]+").findall
        self.plain = np.zeros(0x251, dtype=bool)  # by code point; the last stands for all that follow
        self.plain[[9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]] = True
        self.plain[[0xAD, 0x130]] = False

    def learn(self, new: list[str]) -> None:
        """Cache words: encoded many at a time, parted where a token ends a word."""
        joined = [" ".join(new[at : at + 500]) for at in range(0, len(new), 500)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), dtype=np.int64)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(new) or len(ids) != (ends[-1] if len(ends) else 0):
            raise AssertionError("words and their tokens don't match")
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        self.known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def odd(self, texts: list[str]) -> list[bool]:
        """Which texts go to the tokenizer itself."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        strange = np.searchsorted(ends, np.flatnonzero(~self.plain[np.minimum(points, 0x250)]), side="right")
        found = np.zeros(len(texts), dtype=bool)
        found[strange] = True
        return [x or "<|" in t for x, t in zip(found.tolist(), texts, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [None if odd else self.split(t.lower()) for t, odd in zip(texts, self.odd(texts), strict=True)]
        if len(self.known) > self.words:
            self.known.clear()
        known = self.known.__getitem__
        raw: list[bytes | None] = []
        for text, words in zip(texts, plain, strict=True):
            try:
                raw.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if words is None else b"".join(map(known, words)))
            except KeyError:
                raw.append(None)
        new = [words for words, ids in zip(plain, raw, strict=True) if ids is None]
        self.learn(list(filterfalse(self.known.__contains__, set(chain.from_iterable(new)))))
        return [np.frombuffer((b"".join(map(known, words)) if ids is None else ids) + LAST, dtype="<u4") for words, ids in zip(plain, raw, strict=True)]


class Packer:
    """Level array and open windows of one partition; ``rows`` collects finished pieces."""

    def __init__(self, capacity: int, max_open: int, first_id: int):
        self.capacity, self.max_open, self.next_id = capacity, max_open, first_id
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list] = [[] for _ in range(capacity)]  # windows by level; a window is a list of pieces
        self.n_open = 0
        self.rows: list[tuple] = []

    def emit(self, window: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, c = len(ids), self.capacity
        whole = total // c * c
        for start in range(0, whole, c):
            self.emit([(doc, start, ids[start : start + c], total)])
        if whole < total:
            self.place((doc, whole, ids[whole:], total))

    def level(self, size: int) -> int:
        """The level to add ``size`` to: least growth of the sum of squares, the fullest of equals."""
        n, c = self.counts, self.capacity
        best, least = 0, 2 * n[size] + 1
        levels = n[1 : c - size]
        if len(levels):
            growth = np.where(levels > 0, 2 * (n[1 + size : c] - levels) + 2, np.iinfo(np.int64).max)
            at = len(growth) - 1 - int(growth[::-1].argmin())
            if growth[at] <= least:
                best, least = at + 1, growth[at]
        if n[c - size] and 1 - 2 * n[c - size] <= least:
            best = c - size
        return best

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.level(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        else:
            self.n_open += 1
        window.append(piece)
        if level + size == self.capacity:
            self.n_open -= 1
            self.emit(window)
        else:
            self.counts[level + size] += 1
            self.open[level + size].append(window)
        if self.n_open > self.max_open:
            self.close(False)

    def close(self, last: bool) -> None:
        """Fill the fullest open windows with the contents of the emptiest, cut where they must be."""
        windows = [(level, w) for level in range(self.capacity - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.capacity)]
        self.counts[:] = 0
        self.n_open = 0
        lo, hi, source = 0, len(windows) - 1, []
        while lo <= hi:
            fill, window = windows[lo]
            gap = self.capacity - fill
            while gap and (source or lo < hi):
                if not source:
                    source = windows[hi][1]
                    hi -= 1
                    continue
                doc, start, ids, total = source.pop()
                cut = max(0, len(ids) - gap)
                if cut:
                    source.append((doc, start, ids[:cut], total))
                window.append((doc, start + cut, ids[cut:], total))
                gap -= len(ids) - cut
            lo += 1
            if gap:
                if source:
                    raise AssertionError("a gap is left beside something to fill it")
                self.leave(window, self.capacity - gap, last)
            else:
                self.emit(window)
        if source:
            self.leave(source, sum(len(p[2]) for p in source), last)

    def leave(self, window: list[tuple], fill: int, last: bool) -> None:
        """The one window that stays open, or, at the end, its pieces cut at the powers of two of its length."""
        if not last:
            self.open[fill].append(window)
            self.counts[fill] += 1
            self.n_open += 1
            return
        power = self.capacity
        while fill:
            power //= 2
            if fill < power:
                continue
            fill, need, part = fill - power, power, []
            while need:
                doc, start, ids, total = window.pop(0)
                part.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    window.insert(0, (doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
            self.emit(part)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, max_open: int = 4096, chunk: int = 256) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are the end id alone.  Every row is packed, repeated ones too, and any id, null
    included, is only carried along.  An empty table gives no pieces.  A text of any length is held once, as
    ids.  ``capacity`` is a power of two.  Sequence ids name the input partition in their upper bits, so they
    are unique and, for the same input partitions, the same in every attempt.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = WordCodec(tokenizer_path), Packer(capacity, max_open, TaskContext.get().partitionId() << 36)
        gc.disable()  # lists of words hold no cycles, and there are many
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc, ids in zip(part.column(0).to_pylist(), codec.encode(texts), strict=True):
                        packer.add(doc, ids)
                    if len(packer.rows) > 20_000:
                        yield packer.take()
        finally:
            gc.enable()  # the worker's next task may be another operator's
        packer.close(True)
        yield packer.take()

    return id_texts(docs).mapInArrow(trimmed(pack), SCHEMA)
