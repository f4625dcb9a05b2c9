"""Near-duplicate detection by MinHash.

*Sketch.*  A document's words give the set of its shingles, as 64-bit hashes.  One permutation hashing cuts the
hash range into bins and keeps the least hash of each; a bin without one borrows from a bin that a hash of (bin,
attempt) names, again until it finds one (optimal densification).  ``rows`` bins make a band; the number of bands
follows from the similarity and the share of pairs at that similarity that may be missed.

*Candidates.*  Documents with equal sets are one node.  Nodes that share a band meet in its bucket, in chunks of
bounded size.  A chunk compares the sketches of its members and passes on stars: the member that agrees most with
its likely partners, those partners, and so on with whoever is left, besides each member's likeliest partner.  So
a bucket of m members gives at most 2 m pairs.  Chunks of one bucket are tied together through their hubs.

*Links.*  A candidate pair counts only when confirmed on the full sets.  Connected components follow.

*Rest.*  Then every likely pair of different components that shares a bucket is compared on full sets, chunk against
chunk.  A chunk pair is a block of bounded size that reads each text once, counts all its intersections as one matrix
and passes on a tree of links only, so what it costs beyond its members is comparisons, not rows.  A pair belongs to
the first band it shares.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import filterfalse, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import LOWER, NO_ID, UPPER, id_texts, likely_among, parallelism, smallest_of_group, stored, trimmed, with_salts
from trailmark.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans(UPPER, LOWER)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Likeliest partners that a member of a chunk is tried with besides the stars.
NEAREST = 1
#: Of a sketch; bands take the first of them, and all of them tell how alike two members of a bucket are.
BINS = 256


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORDS.findall(text.lower() if text.isascii() else text.translate(_FOLD))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of whole texts; words are hashed once and remembered."""

    def __init__(self, size: int, held: int = 500_000):
        self.size, self.held = size, held
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.held:
            known.clear()
        for w in filterfalse(known.__contains__, set(words)):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = _mix((out ^ one[i : i + n]) * _ODD + np.uint64(1))
        return np.unique(out)


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, max(BINS, bands * rows)
        at = np.arange(self.bins, dtype=np.uint64)
        #: The bin that a bin borrows from at each attempt.
        self.lenders = [(_mix(at * np.uint64(1000) + np.uint64(i + 1)) % np.uint64(self.bins)).astype(np.int64) for i in range(1000)]

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin, densified; hashes are sorted and there is at least one."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        held, first = np.unique(bins, return_index=True)
        full = np.zeros(self.bins, bool)
        full[held] = True
        values = np.zeros(self.bins, np.uint64)
        values[held] = hashes[first]
        todo = np.flatnonzero(~full)
        for lenders in self.lenders:
            if not len(todo):
                return values
            lender = lenders[todo]
            found = full[lender]
            values[todo[found]] = values[lender[found]]
            todo = todo[~found]
        values[todo] = hashes[0]  # as good as never: a thousand attempts
        return values

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One signed 64-bit key per band."""
        parts = values[: self.bands * self.rows].reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            out = _mix((out ^ parts[:, i]) * _ODD + np.uint64(1))
        return out.view(np.int64)


def bands_for(similarity: float, rows: int, missed: float) -> int:
    return max(1, math.ceil(math.log(missed) / math.log(1 - similarity**rows)))


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, d1, d2, sketch, keys``: set size, 128-bit digest of the set, a byte of each bin, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(size), Sketcher(bands, rows)
        for batch in batches:
            ids, ns, d1, d2, sk, ks = batch.column(0).fill_null(NO_ID), [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingler.hashes(text)
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                ns.append(len(hashes))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(hashes):
                    values = sketcher.bins_of(hashes)
                    sk.append((_mix(values) & np.uint64(255)).astype(np.uint8).tobytes())
                    ks.append(sketcher.keys(values))
                else:
                    sk.append(b"")
                    ks.append(np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ks)]).astype(np.int32), np.concatenate(ks) if ks else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary()), lists], names=["doc_id", "n", "d1", "d2", "sketch", "keys"])

    return id_texts(docs).mapInArrow(trimmed(run), "doc_id long, n long, d1 long, d2 long, sketch binary, keys array<long>")


def _likely(ours: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The agreement of sketches, ours by theirs, and where it makes a pair of different homes likely."""
    (sizes, matrix, homes), (sizes_, matrix_, homes_) = ours, theirs
    agree = np.empty((len(matrix), len(matrix_)), np.float32)
    for at in range(0, len(matrix), 64):
        agree[at : at + 64] = (matrix[at : at + 64, None, :] == matrix_[None, :, :]).mean(axis=2, dtype=np.float32)
    least = np.minimum(sizes[:, None], sizes_[None, :])
    likely = agree >= similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.minimum(least, matrix.shape[1]))
    likely &= least >= similarity * np.maximum(sizes[:, None], sizes_[None, :]) - 1e-9
    likely &= homes[:, None] != homes_[None, :]
    return agree, likely


def _stars(ids: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, similarity: float, nearest: int) -> tuple[list[tuple[int, int]], int]:
    """Pairs to confirm among the members of a chunk, and its first hub."""
    m = len(matrix)
    agree, likely = _likely((sizes, matrix, ids), (sizes, matrix, ids), similarity)
    weight = np.where(likely, agree, 0)
    mass = weight.sum(axis=1)
    hub = int(mass.argmax())
    if not mass[hub]:
        return [], int(ids[hub])
    pairs: set[tuple[int, int]] = set()
    left = mass > 0
    while left.any():
        here = int(np.where(left, (weight * left).sum(axis=1), -1).argmax())
        near = likely[here] & left
        pairs.update((min(here, x), max(here, x)) for x in np.flatnonzero(near).tolist())
        left &= ~near
        left[here] = False
    for _ in range(min(nearest, m - 1)):
        best = weight.argmax(axis=1)
        for x, y in enumerate(best.tolist()):
            if weight[x, y]:
                pairs.add((min(x, y), max(x, y)))
        weight[np.arange(m), best] = 0
    return [(int(ids[x]), int(ids[y])) for x, y in pairs], int(ids[hub])


def buckets(nodes: DataFrame, salts: int = 64) -> DataFrame:
    """``salt, key, m, doc_id, n, sketch`` of the members of all buckets of two and more; m is the bucket's size.

    A bucket is counted map-side first and its count goes back to its salts, so no task holds a whole hot bucket.
    """
    member = nodes.select("doc_id", F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(salts)).cast("int"))
    full = member.groupBy("key").agg(F.count("*").alias("m"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).filter("m > 1")
    return member.join(with_salts(full, salts), ["salt", "key"]).join(nodes.select("doc_id", "n", "sketch"), "doc_id").select("salt", "key", "m", "doc_id", "n", "sketch")


def candidates(members: DataFrame, similarity: float, nearest: int = NEAREST, chunk: int = 256) -> DataFrame:
    """``a, b`` (a < b): pairs of ``buckets`` worth confirming, each once.

    Every bucket is dealt to chunks in its own way, so two members are apart in some of their buckets at most.
    """
    dealt = members.withColumn("part", F.expr(f"pmod(xxhash64(31, key, doc_id), ceil(m / {chunk}))")).withColumn("parted", F.col("m") > chunk)
    dealt = dealt.select("key", "part", "parted", "doc_id", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)

        out: list[tuple] = []
        for (key, _, parted), group in groupby(rows(), key=itemgetter(0, 1, 2)):
            members = list(group)
            ids = np.array([r[3] for r in members], np.int64)
            matrix = np.frombuffer(b"".join(r[5] for r in members), np.uint8).reshape(len(members), -1)
            pairs, hub = _stars(ids, np.array([r[4] for r in members], np.int64), matrix, similarity, nearest)
            out.extend((min(p), max(p), None) for p in pairs)
            if parted:
                out.append((hub, None, key))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        a, b, k = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "key"])

    spark = dealt.sparkSession
    found = dealt.repartition(parallelism(spark), "key", "part").sortWithinPartitions("key", "part").mapInArrow(trimmed(run), "a long, b long, key long")
    found = stored(found, "mh-pairs")
    hubs = found.filter("key IS NOT NULL").select("key", F.col("a").alias("hub"))
    least = hubs.groupBy("key").agg(F.min("hub").alias("least"))
    tied = hubs.join(least, "key").select(F.col("least").alias("a"), F.col("hub").alias("b")).filter("a < b")
    return found.filter("key IS NULL AND a < b").select("a", "b").unionByName(tied).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int, chunk: int = 256) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets meet 100 * intersection >= percent * union.

    The texts of one a's partners are read in one run after a's own; an a of many partners is dealt to several.
    Texts are joined by a merge whatever the sizes: pairs grow with the corpus, so a broadcast would only hold
    for small ones.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(degree, "a").select("a", "b", F.expr(f"pmod(xxhash64(37, b), ceil(m / {chunk}))").alias("part"))
    asked = dealt.select("a", "part", F.col("b").alias("doc_id")).unionByName(dealt.select("a", "part", F.col("a").alias("doc_id")).distinct())
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = likely_among(texts, asked)
    rows = asked.join(texts.hint("shuffle_merge"), "doc_id").select("a", "part", F.expr("doc_id <> a").alias("partner"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        at, own = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, part, partner, doc, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                hashes = shingler.hashes(text)
                if (a, part) != at:
                    at, own = (a, part), []
                if not partner:
                    own.append(hashes)
                    continue
                for ours in own:
                    both = len(np.intersect1d(ours, hashes, assume_unique=True))
                    if both and 100 * both >= percent * (len(ours) + len(hashes) - both):
                        a_out.append(a)
                        b_out.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    placed = rows.repartition(parallelism(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "partner")
    return placed.mapInArrow(trimmed(run), "a long, b long")


def blocks(members: DataFrame, drawn: DataFrame, homes: DataFrame, similarity: float, chunk: int = 1024, shingles: int = 2_000_000) -> DataFrame:
    """``key, p, q, side, doc_id, home``: who is to be compared in which block, one side with the other.

    A bucket's members are dealt to chunks of about ``chunk`` members and ``shingles`` shingles at most, and a block
    is a pair of its chunks, or one chunk with itself.  Members of the component that has most of a larger bucket
    have chunks of their own, which do not meet.  Of a block only those go on that have a likely partner in another
    component with whom they share no earlier band.
    """
    named = members.select("salt", "key", "doc_id", "n").join(homes, F.col("doc_id") == F.col("node"), "left").select("salt", "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("home"))
    by_home = named.groupBy("key", "home").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    by_key = by_home.groupBy("key").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "home")).alias("top"), F.bit_or("salts").alias("salts")).filter("m > top.m")
    parts = lambda m, n: f"cast(ceil(greatest(({m}) / {chunk}, ({n}) / {shingles})) AS long)"
    whole = by_key.withColumn("one", F.expr(f"{parts('m', 'n')} <= 1"))
    dealt_to = whole.select("key", "salts", F.expr("IF(one, NULL, top.home)").alias("main"), F.expr(f"IF(one, 1L, {parts('m - top.m', 'n - top.n')})").alias("rest"), F.expr(f"IF(one, 0L, {parts('top.m', 'top.n')})").alias("mains"))
    chosen = F.xxhash64(F.lit(41), "key", "doc_id")
    of_main = F.col("home").eqNullSafe(F.col("main"))
    placed = named.select("salt", "key", "doc_id", "home").distinct().join(with_salts(dealt_to), ["salt", "key"])
    placed = placed.withColumn("part", F.when(of_main, F.col("rest") + F.pmod(chosen, F.greatest(F.col("mains"), F.lit(1)))).otherwise(F.pmod(chosen, "rest")))
    placed = placed.withColumn("other", F.explode(F.expr("IF(part >= rest, sequence(0L, rest - 1), sequence(0L, rest + mains - 1))")))
    placed = stored(placed.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.expr("int(part > other)").alias("side"), "doc_id", "home"), "mh-placed")
    rows_ = likely_among(drawn.filter("n > 0").select("doc_id", "n", "sketch", "keys"), placed).join(placed, "doc_id").select("key", "p", "q", "side", "doc_id", "home", "n", "sketch", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True)

        out: list[tuple] = []
        for (key, p, q), group in groupby(rows(), key=itemgetter(0, 1, 2)):
            # Of an id with several texts only those of this bucket count.
            members = [r for r in group if key in r[8]]
            homes_ = np.array([r[5] for r in members], np.int64)
            if not len(members) or (homes_ == homes_[0]).all():
                continue
            sizes = np.array([r[6] for r in members], np.int64)
            matrix = np.frombuffer(b"".join(r[7] for r in members), np.uint8).reshape(len(members), -1)
            keys = np.array([r[8] for r in members], np.int64)
            first, second = _sides(p, q, [r[3] for r in members])
            _, near = _likely((sizes[second], matrix[second], homes_[second]), (sizes[first], matrix[first], homes_[first]), similarity)
            for band in range(members[0][8].index(key)):
                near &= keys[second, band][:, None] != keys[first, band][None, :]
            asked = np.zeros(len(members), bool)
            asked[first] |= near.any(axis=0)
            asked[second] |= near.any(axis=1)
            out.extend((key, p, q, members[i][3], members[i][4], members[i][5]) for i in np.flatnonzero(asked).tolist())
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "p", "q", "side", "doc_id", "home"])

    dealt = rows_.repartition(parallelism(members.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q", "side")
    return dealt.mapInArrow(trimmed(run), "key long, p long, q long, side long, doc_id long, home long")


def _sides(p: int, q: int, sides: list[int]) -> tuple[slice, slice]:
    """Which members, side 0 before side 1, meet which; all of a chunk meet all where it is its own partner."""
    ours = len(sides) - sum(sides) if p != q else len(sides)
    return slice(0, ours), slice(ours, None) if p != q else slice(None)


def intersections(sets: list[np.ndarray], first: slice, second: slice, few: int = 6, width: int = 4096) -> np.ndarray:
    """How many hashes each set of ``first`` has in common with each other one of ``second``.

    Hashes of at most ``few`` sets are counted pair by pair, the others as products of 0-1 matrices of ``width`` columns.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    held = np.diff(np.concatenate((starts, [len(hashes)])))
    ours, theirs = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    ours[first], theirs[second] = True, True
    row, column = np.cumsum(ours) - 1, np.cumsum(theirs) - 1
    out = np.zeros((int(ours.sum()), int(theirs.sum())), np.float32)
    flat = out.reshape(-1)
    for k in range(2, few + 1):
        at = starts[held == k]
        for i in range(k):
            for j in range(k):
                a, b = owner[at + i], owner[at + j]
                both = ours[a] & theirs[b] if i != j else np.zeros(len(a), bool)
                np.add.at(flat, row[a[both]] * out.shape[1] + column[b[both]], 1)
    many = np.flatnonzero(held > few)
    for low in range(0, len(many), width):
        part = many[low : low + width]
        x = np.zeros((len(sets), len(part)), np.float32)
        x[np.concatenate([owner[starts[c] : starts[c] + held[c]] for c in part]), np.repeat(np.arange(len(part)), held[part])] = 1
        out += x[first] @ x[second].T
    return out.astype(np.int64)


def confirmed_in_blocks(docs: DataFrame, asked: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: of all pairs of ``blocks`` in different components whose full sets meet the threshold, those that tie what the block has not tied yet."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = asked.join(likely_among(texts, asked).hint("shuffle_merge"), "doc_id").select("key", "p", "q", "side", "doc_id", "home", "text")

    def links(members: list[tuple], p: int, q: int) -> Iterator[tuple[int, int]]:
        first, second = _sides(p, q, [m[0] for m in members])
        ids, homes = (np.array([m[i] for m in members], np.int64) for i in (1, 2))
        sizes = np.array([len(m[3]) for m in members], np.int64)
        both = intersections([m[3] for m in members], first, second)
        ones, twos = np.nonzero((both > 0) & (100 * both >= percent * (sizes[first][:, None] + sizes[second][None, :] - both)) & (homes[first][:, None] != homes[second][None, :]))
        _, place = np.unique(homes, return_inverse=True)
        ones, twos = ones + first.start, twos + (second.start or 0)
        above = np.arange(len(members))
        while len(ones):
            # One link of each component and round ties it; links inside what is tied by now are left out.
            _, picked = np.unique(above[place[ones]], return_index=True)
            for i, j in zip(ones[picked].tolist(), twos[picked].tolist(), strict=True):
                x, y = _root(above, int(place[i])), _root(above, int(place[j]))
                if x != y:
                    above[x] = y
                    yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))
            above = np.array([_root(above, x) for x in range(len(above))])
            apart = above[place[ones]] != above[place[twos]]
            ones, twos = ones[apart], twos[apart]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        for (_, p, q), group in groupby(rows(), key=itemgetter(0, 1, 2)):
            found = list(links([(r[3], r[4], r[5], shingler.hashes(r[6])) for r in group], p, q))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    placed = rows.repartition(parallelism(docs.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q", "side")
    return placed.mapInArrow(trimmed(run), "a long, b long")


def _root(above: np.ndarray, x: int) -> int:
    while above[x] != x:
        x = int(above[x])
    return x


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 4, missed: float = 1e-5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer than ``size`` words is
    one shingle, a text without words (null, empty) none: it is linked with nothing and kept.  Equal sets are
    linked without a comparison.  Rows that share an id are one document: its texts are linked with each other.
    Null ids are one such document.  An empty table gives an empty result; texts are read whole.
    """
    similarity = percent / 100
    drawn = stored(sketches(docs, size, bands_for(similarity, rows, missed), rows), "mh-sketches")
    salted, winners = smallest_of_group(drawn.filter("n > 0").select("doc_id", "n", "d1", "d2"), ["d1", "d2", "n"], "doc_id")
    winners = stored(winners, "mh-sets")
    one = winners.select(F.col("smallest").alias("doc_id"), "d1", "d2")
    nodes = drawn.join(one, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "n", "sketch", "keys")
    # An id with several texts ties the sets of its texts.
    several = salted.join(with_salts(winners), ["salt", "d1", "d2", "n"]).filter("doc_id <> smallest").groupBy("doc_id").agg(F.min("smallest").alias("lo"), F.max("smallest").alias("hi")).filter("lo < hi")
    members = stored(buckets(nodes), "mh-buckets")
    pairs = stored(candidates(members, similarity), "mh-candidates")
    links = stored(confirmed(docs, pairs, size, percent).unionByName(several.select(F.col("lo").alias("a"), F.col("hi").alias("b"))), "mh-links")
    component = connected_components(links)
    # What the stars left out: all likely pairs of different components.
    rest = stored(blocks(members, drawn, component, similarity), "mh-blocks")
    if not rest.isEmpty():
        more = stored(confirmed_in_blocks(docs, rest, size, percent), "mh-links")
        if not more.isEmpty():
            component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = winners.join(component, F.col("smallest") == F.col("node"), "left").select("d1", "d2", "n", "salts", F.coalesce("component", "smallest").alias("component_id"))
    linked = salted.join(with_salts(named), ["salt", "d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = drawn.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    clean = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return linked.unionByName(alone).select(clean("doc_id"), "n_shingles", clean("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without rows whose document isn't the smallest id of its component, all columns as they came.

    Rows with a null id are kept: null orders below every id, and a join on ids doesn't find it.  Texts without words,
    null and empty ones among them, are kept; rows repeated with an id share their decision.
    """
    gone = stored(near_duplicates(docs, size, percent).filter("NOT kept").select("doc_id").distinct(), "mh-gone")
    # Most rows are known to stay without being shuffled.
    left = likely_among(docs, gone).join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*docs.columns)
    return likely_among(docs, gone, others=True).unionByName(left)
