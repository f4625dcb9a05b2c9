"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it is one less than a multiple of the block size;
each chunk gives one letter, a hash of its bytes, and the letters make a signature.  The block size starts at
3 * 2^i, large enough for the whole text to give at most 64 letters on average, and is halved while the signature
has less than 32.  A fingerprint holds the signatures at the block size and at twice it, so two fingerprints can be
compared by edit distance wherever they share a block size.  Rolling hash and boundaries are array expressions
over all bytes of the text at once; no text is cut short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import id_texts, parallelism

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte: sum, weighted sum and shifted xor of the bytes of the window that ends there, added up."""
    wide = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    n = len(data)
    total, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        at = wide[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += at
        weighted += at * np.uint32(WINDOW - back)
        shifted ^= at << np.uint32(5 * back % 32)
    return total + weighted + shifted


def signature(data: bytes, hashes: np.ndarray, block: int) -> str:
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)[: LENGTH - 1] + 1
    out, begin = [], 0
    for end in ends.tolist():
        out.append(LETTERS[zlib.crc32(data[begin:end]) & 63])
        begin = end
    if begin < len(data):
        out.append(LETTERS[zlib.crc32(data[begin:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; of an empty text ``3::``."""
    data = text.encode("utf-8", "surrogatepass")
    hashes = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        first = signature(data, hashes, block)
        if block == LEAST_BLOCK or len(first) >= LENGTH // 2:
            return f"{block}:{first}:{signature(data, hashes, 2 * block)}"
        block //= 2


def common_subsequence(a: str, b: str) -> int:
    """Its length, with one bit for each letter of ``a`` in a number."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        both = state & masks.get(x, 0)
        state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


def alike(a: str, b: str, run: int = 4) -> float:
    """1 minus the edit distance (insertions and deletions) over both lengths; 0 without a common run of letters.

    The run is ``run`` letters, or a quarter of the shorter signature where that is less.
    """
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    least = max(1, min(run, min(len(a), len(b)) // 4))
    if not {a[i : i + least] for i in range(len(a) - least + 1)} & {b[i : i + least] for i in range(len(b) - least + 1)}:
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """The best over the block sizes that both fingerprints have; 0 where they have none."""
    if a == b:
        return 1.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    ours, theirs = {int(x): xs[0], 2 * int(x): xs[1]}, {int(y): ys[0], 2 * int(y): ys[1]}
    return max((alike(ours[k], theirs[k]) for k in ours.keys() & theirs.keys()), default=0.0)


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, rows_per_part: int = 1024, part_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row, see SCHEMA: fingerprints of each text, of its edited text, and their likeness.

    The next document is the next row in ascending id, after the last the first.  Ids are cut into ranges at
    approximate quantiles: one a shuffle partition, or as many as leave about ``part_bytes`` of text each, and none
    of much less than ``rows_per_part`` rows.  A range is a task, which reads its rows in order, and the first row of a
    range is also sent, as a guest, to the range before it, so every text travels once and one row a range twice.
    Null texts are empty.
    Null ids come first.  Rows repeated with one id follow each other in the order of their texts.  An only row
    is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = id_texts(docs)
    # Ids decide the ranges; of the texts only the sizes are summed.
    ids = own.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    held_ = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    n, wanted = held_["n"], max(parallelism(spark), -(-(held_["bytes"] or 0) // part_bytes))
    parts = max(1, min(-(-n // rows_per_part), wanted))
    bounds: list[int] = []
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(max(10_000, 20 * parts)))).first()[0]))
    part_of = _part(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), bounds)
    firsts = {r["part"]: r["first"] for r in ids.groupBy(part_of.alias("part")).agg(F.min("doc_id").alias("first")).collect()}
    held = sorted(firsts)
    # A guest goes to the range before its own; the first row of all goes to the last range.
    before = {firsts[p]: held[i - 1] for i, p in enumerate(held)}
    limit = np.array(bounds, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_here = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(limit, ids_here, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.zeros(len(part), bool)), batch.column(0), batch.column(1)], names=["part", "guest", "doc_id", "text"])
            at = [i for i, x in enumerate(ids_here.tolist()) if x in before]
            if at:
                some = batch.take(pa.array(at))
                to = [before[x] for x in ids_here[at].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([True] * len(at)), some.column(0), some.column(1)], names=["part", "guest", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting: tuple | None = None

        def finished(row: tuple, text: str, print_: str) -> tuple:
            _, doc, own_text, own_print = row
            other = edited(own_text, text)
            other_print = fingerprint(other)
            return doc, len(own_text), sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own_print, other_print, likeness(own_print, other_print), likeness(own_print, print_)

        for batch in batches:
            out = []
            for part, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and waiting is None:
                    continue  # of several guests with one id the first is next
                text = text or ""
                print_ = fingerprint(text)
                if waiting is not None:
                    out.append(finished(waiting, text, print_))
                waiting = None if guest else (part, doc, text, print_)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if waiting is not None:
            raise AssertionError("a range without its guest")

    dealt = own.mapInArrow(deal, "part long, guest boolean, doc_id long, text string")
    placed = dealt.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return placed.mapInArrow(compare, SCHEMA)


def _part(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id."""
    if not bounds:
        return F.lit(0).cast("long")
    limit = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limit, ids.to_numpy(dtype=np.int64), side="right"))

    return part(doc_id)
