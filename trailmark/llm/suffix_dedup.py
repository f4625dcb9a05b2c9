"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  The work is dealt so that
equal strings meet without comparing everything with everything:

* *Anchors.*  Each string of ``passage`` bytes picks the least hashed ``gram`` bytes in it (the first of equals), so
  equal strings, and longer ones that begin with them, pick equal anchors.  The starts that pick one anchor are a
  run; the bytes of the ``length``-byte strings there are its segment.  A string can only repeat if its anchor does,
  so anchors are counted, map-side first, and only segments of repeated anchors go on.  Copies of a segment are one
  segment with a weight; where an anchor has one content only, its weight decides.
* *Shards.*  The other segments meet by anchor in shards of about ``shard`` bytes.  A shard sorts its suffixes by
  Larsson-Sadakane refinement: ranks by eight bytes, then doubled depth among the groups that are still unsorted,
  until the depth passes ``length``.  The ranks by a depth on the way tell which neighbours share ``length`` bytes
  (Kasai's pass does for passages under eight bytes); those are one string, and its occurrences are weighed.  Neighbours that share ``passage`` bytes are one
  passage, which counts where it occurs in several documents.
* *Merging.*  An anchor with more contents than a shard takes is dealt to several.  Each passes its distinct
  strings on in sorted order, cut into ranges, and a range finds strings of one shard in the others by binary search.

What is found per segment goes back to every place it occurs, and each document is cut once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import id_texts, likely_among, parallelism, stored, with_salts

_ODD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
ANCHORS = "h long, d1 long, d2 long, doc_id long, rid long, lo int, starts int"
#: A string of a segment: digest, segment, start there, 1 for a passage, the document, and whether it is known to occur again.
STRINGS = np.dtype([("x", "<u8"), ("y", "<u8"), ("d1", "<i8"), ("d2", "<i8"), ("start", "<i4"), ("wide", "u1"), ("rid", "<i8"), ("found", "u1")])
SALTS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place."""
    out, width, base = data.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    while width < gram:
        out = out[:-width] * np.uint64(base) + out[width:]
        base = base * base % 2**64
        width *= 2
    return _mix(out * _ODD)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: minima from both ends of blocks of that width."""
    n = len(values)
    padded = np.concatenate((values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, the first start that picks it, and how many do; starts that pick it are neighbours."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    picked = (window_minima(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
    starts = np.diff(np.concatenate((lo, [len(picked)])))
    return hashes[picked[lo]].view(np.int64), lo.astype(np.int32), starts.astype(np.int32)


def suffix_order(data: np.ndarray, depth: int, kept: dict[int, np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``depth`` bytes, their ranks (ties share one), and each place's 8 bytes.

    ``kept`` has depths (8 doubled) as keys and gets the ranks by that many bytes.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(eight)
    keys = eight[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    h, kept = 8, {} if kept is None else kept
    if h in kept:
        kept[h] = rank.copy()
    while h < depth and len(slots):
        members = order[slots]
        ahead = members + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = (rank[members] << 32) | second
        by = np.argsort(keys)
        keys, members = keys[by], members[by]
        order[slots] = members
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        h *= 2
        if h in kept:
            kept[h] = rank.copy()
    # Where all is sorted before that depth, no ranks are shared there either.
    kept.update({k: rank for k, r in kept.items() if r is None})
    return order, rank, eight


def shares(order: np.ndarray, rank: np.ndarray, depth: int, width: int) -> np.ndarray:
    """For each slot of ``order``: whether it has its first ``width`` bytes in common with the slot before.

    ``rank`` is by ``depth`` bytes, at most ``width``: places ``depth`` apart are compared by rank, and the last one
    where it ends with the string.
    """
    a, b = order[1:], order[:-1]
    near = np.flatnonzero((rank[a] == rank[b]) & (np.maximum(a, b) + width <= len(order)))
    for at in [*range(depth, width - depth, depth), width - depth]:
        near = near[rank[a[near] + at] == rank[b[near] + at]]
    out = np.zeros(len(order), bool)
    out[near + 1] = True
    return out


def common_prefixes(order: np.ndarray, rank: np.ndarray, eight: np.ndarray, most: int, lanes: int | None = None) -> np.ndarray:
    """For each slot of ``order``: the common prefix with the slot before, at most ``most``.

    Kasai's pass: the prefix at a place is at least that at the place before, less one.  The text is cut into
    stretches (``lanes`` of them, 16 places each by default) that take their steps together, eight bytes a comparison.  Where neighbours share a rank
    the depth of sorting has shown it already, and nothing carries over from there.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    out = np.zeros(n, np.int64)
    step = -(-n // lanes) if lanes else 16
    here = np.arange(0, n, step)
    common = np.zeros(len(here), np.int64)
    for j in range(step):
        at = here + j
        at = at[at < n]
        k = np.maximum(common[: len(at)] - 1, 0)
        prev = before[at]
        known = tied[at]
        k[known] = most
        k[prev < 0] = 0
        todo = np.flatnonzero(~known & (prev >= 0))
        while len(todo):
            x, y = at[todo] + k[todo], prev[todo] + k[todo]
            inside = (x < n) & (y < n)
            todo, x, y = todo[inside], x[inside], y[inside]
            differ = eight[x] ^ eight[y]
            same = differ == 0
            rest = differ[~same]
            bytes_ = np.zeros(len(rest), np.int64)
            for b in range(1, 8):
                bytes_ += rest < np.uint64(1 << (64 - 8 * b))
            k[todo[~same]] += bytes_
            todo = todo[same]
            k[todo] += 8
            todo = todo[k[todo] < most]
        k = np.minimum(k, most)
        out[place[at]] = k
        common = np.where(known, 0, k)
    out[0] = 0
    return out


def repeated_starts(
    segments: list[bytes], starts: list[int], weights: list[int], rids: list[int], many: list[bool], length: int, passage: int
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each segment: its own starts whose string occurs again by weight, and those whose passage occurs in another document.

    Also, in sorted order, segment, start, 1 for a passage and whether it counts, of every distinct string and passage,
    and of every place of a passage that doesn't count.  ``rids`` name a segment's document, ``many`` tells of a segment
    that several documents hold.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if passage < 8:
        order, rank, eight = suffix_order(data, length)
        shared = common_prefixes(order, rank, eight, length)
        full, short = shared >= length, shared >= passage
    else:
        depth = 2 ** (passage.bit_length() - 1)
        kept: dict[int, np.ndarray | None] = {depth: None}
        order, _, _ = suffix_order(data, length, kept)
        full, short = (shares(order, kept[depth], depth, width) for width in (length, passage))
    owner = np.repeat(np.arange(len(segments)), sizes)[order]
    place = order - begins[owner]
    own = place < np.array(starts)[owner]
    whole = own & (order + length <= ends[owner])  # strings, not what runs on into the next segment
    group = np.cumsum(~full) - 1
    weight = np.bincount(group[whole], weights=np.array(weights)[owner[whole]], minlength=group[-1] + 1)
    again = weight[group] >= 2
    wide = own & (order + passage <= ends[owner])
    part = np.cumsum(~short) - 1
    rid = np.array(rids, np.int64)[owner[wide]]
    least, most = np.full(part[-1] + 1, np.iinfo(np.int64).max), np.full(part[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, part[wide], rid)
    np.maximum.at(most, part[wide], rid)
    held = np.bincount(part[wide], weights=np.array(many, float)[owner[wide]], minlength=part[-1] + 1) > 0
    apart = (held | (least < most))[part]
    found = []
    for mask in (whole & again, wide & apart):
        marked = np.zeros(len(data), bool)
        marked[order[mask]] = True
        found.append([np.flatnonzero(marked[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
    strings = []
    for mask, groups, hit, kind in ((whole, group, again, 0), (wide, part, apart, 1)):
        slots = np.flatnonzero(mask)
        if len(slots):
            slots = slots[np.concatenate(([True], groups[slots][1:] != groups[slots][:-1])) | ((kind == 1) & ~hit[slots])]
        strings.append(np.column_stack((owner[slots], place[slots], np.full(len(slots), kind), hit[slots])))
    return found[0], found[1], np.concatenate(strings)


def _runs(starts: np.ndarray) -> list[int]:
    """first, last, first, last, ... of neighbouring numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack((starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))])).ravel().tolist()


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)


def _find_anchors(docs: DataFrame, length: int, passage: int, gram: int) -> DataFrame:
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for doc, rid, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                h, lo, starts = anchors(data, passage, gram)
                if len(h):
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a : a + n + length - 1], n) for a, n in zip(lo.tolist(), starts.tolist(), strict=True)), "<i8").reshape(-1, 2)
                    parts.append((h, digests[:, 0], digests[:, 1], [doc.as_py()] * len(h), np.full(len(h), rid), lo, starts))
            if parts:
                columns = [np.concatenate([p[i] for p in parts]) if i != 3 else [d for p in parts for d in p[3]] for i in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, ANCHORS)


def _salted(rows: DataFrame, keys: list[str], salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a salt, and ``keys, m, salts``: how many rows a key has and their salts as bits (counted map-side first)."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(23), salt), F.lit(SALTS)).cast("int"))
    return rows, rows.groupBy(*keys).agg(F.count("*").alias("m"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 256, gram: int = 64, shard: int = 500_000, contents: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages``, and ``spans`` as first, end, ...

    Texts are UTF-8 bytes, read whole; a null text is empty, and texts under ``length`` bytes lose nothing.
    Strings never cross documents.  A row repeated with its id is one more document with the same text, so all its
    strings repeat.  Null ids are carried along.  An empty table gives an empty result.
    ``n_passages`` counts the maximal runs of bytes covered by strings of ``passage`` bytes (at most ``length``) that
    other documents have too, whether they are long enough to be removed or not; rows repeated with their id are one
    document there.
    """
    if not gram <= passage <= length:
        raise ValueError("gram is at most passage, and passage at most length")
    spark = docs.sparkSession
    texts = id_texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    every = stored(_find_anchors(texts.filter(F.octet_length("text") >= passage), length, passage, gram), "sa-anchors")
    salted, twice = _salted(every, ["h"], "rid")
    twice = with_salts(twice.filter("m > 1").select("h", "salts"), SALTS)
    found = stored(salted.join(twice, ["h", "salt"], "left_semi"), "sa-repeated", instead_of=every)
    content = ["h", "d1", "d2"]
    held = F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"), F.min(F.struct("doc_id", "rid", "lo", "starts")).alias("at"), F.max(F.struct("doc_id", "rid")).alias("far")
    by_content = found.groupBy(*content).agg(*held)
    several = ~(F.col("at.doc_id").eqNullSafe(F.col("far.doc_id")) & (F.col("at.rid") == F.col("far.rid")))
    by_content = stored(by_content.select(*content, "n", "salts", several.alias("many"), "at.doc_id", "at.rid", "at.lo", "at.starts"), "sa-contents")
    keyed, by_anchor = _salted(by_content.withColumnRenamed("salts", "held"), ["h"], "d1")
    by_anchor = with_salts(by_anchor.filter("m > 1").select("h", F.expr(f"ceil(m / {contents})").alias("parts"), "salts"), SALTS)
    mixed = keyed.join(by_anchor, ["h", "salt"]).select(*content, "n", "many", "held", "doc_id", "rid", "lo", "starts", "parts", F.expr("pmod(xxhash64(41, d1), parts)").alias("part"))
    asked = mixed.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("h", "part", "parts", "d1", "d2", "n", "many", "held", "lo", "starts")).alias("segments"))
    asked = stored(asked, "sa-asked")
    segment = ["h", "part", "parts", "d1", "d2", "n", "held", "rid", "starts", "many", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, segments, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                out.extend((*(x[k] for k in segment[:7]), rid, x["starts"], x["many"], data[x["lo"] : x["lo"] + x["starts"] + length - 1]) for x in segments)
            columns = list(zip(*out, strict=True)) or [()] * len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:9]] + [pa.array(columns[9], pa.bool_()), pa.array(columns[10], pa.binary())], names=segment)

    same = F.col("a.rid").eqNullSafe(F.col("t.rid")) & F.col("a.doc_id").eqNullSafe(F.col("t.doc_id"))
    cut_schema = ", ".join(f"{x} long" for x in segment[:9]) + ", many boolean, data binary"
    segments = asked.alias("a").join(likely_among(texts, asked, "rid").alias("t"), same).select("a.rid", "a.segments", "t.text").mapInArrow(cut, cut_schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0
        for _, rows in groupby(_rows(batches, len(segment)), key=itemgetter(0, 1)):
            group = list({(r[3], r[4]): r for r in rows}.values())
            kept += group
            size += sum(len(r[10]) for r in group)
            if size >= shard:
                yield _search(kept)
                kept, size = [], 0
        if kept:
            yield _search(kept)

    def _search(rows: list[tuple]) -> pa.RecordBatch:
        found, wide, strings = repeated_starts([r[10] for r in rows], [r[8] for r in rows], [r[5] for r in rows], [r[7] for r in rows], [r[9] for r in rows], length, passage)
        # What a content's own copies show is known already.
        out: list[tuple] = [(r[0], r[3], r[4], r[6], [] if r[5] > 1 else _runs(f), [] if r[9] else _runs(w), None, None) for r, f, w in zip(rows, found, wide, strict=True) if (r[5] == 1 and len(f)) or (not r[9] and len(w))]
        shared: dict[tuple[int, int], list] = {}
        parted = np.array([r[2] > 1 for r in rows])[strings[:, 0]]
        for i, start, kind, hit in strings[parted].tolist():
            r = rows[i]
            digest = xxhash.xxh3_128_digest(r[10][start : start + (passage if kind else length)])
            x, y = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
            shared.setdefault((r[0], x * r[2] >> 64), []).append((x, y, r[3], r[4], start, kind, r[7], hit))
        for (h, bucket), items in shared.items():
            out.append((h, None, None, None, None, None, bucket, np.sort(np.array(items, STRINGS), order=["x", "y"]).tobytes()))
        # Of a part's contents the merge sends on what it finds, so it needs to know their salts.
        out.extend((r[0], r[3], r[4], r[6], [], [], None, None) for r in rows if r[2] > 1)
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "d1", "d2", "held", "runs", "wide", "bucket", "strings"])

    schema = "h long, d1 long, d2 long, held long, runs array<int>, wide array<int>, bucket long, strings binary"
    n = parallelism(spark)
    searched = stored(segments.repartition(n, "h", "part").sortWithinPartitions("h", "part").mapInArrow(search, schema), "sa-found")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, _), rows in groupby(_rows(batches, 3), key=itemgetter(0, 1)):
            shards = [np.frombuffer(r[2], STRINGS) for r in rows]
            pool = np.concatenate(shards)
            shard_of = np.repeat(np.arange(len(shards)), [len(x) for x in shards])
            order = np.argsort(pool["x"], kind="stable")
            pool, shard_of = pool[order], shard_of[order]
            out: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
            for i, own in enumerate(shards):
                own = own[own["found"] == 0]
                hit = np.zeros(len(own), bool)
                at = np.searchsorted(pool["x"], own["x"])
                stop = np.searchsorted(pool["x"], own["x"], side="right")
                while (live := np.flatnonzero((at < stop) & ~hit)).size:
                    other, mine = pool[at[live]], own[live]
                    equal = (other["y"] == mine["y"]) & (other["wide"] == mine["wide"]) & (shard_of[at[live]] != i)
                    hit[live] = equal & ((mine["wide"] == 0) | (other["found"] == 1) | (other["rid"] != mine["rid"]))
                    at[live] += 1
                for row in own[hit]:
                    out.setdefault((int(row["d1"]), int(row["d2"])), ([], []))[int(row["wide"])].append(int(row["start"]))
            items = [(h, d1, d2, _runs(np.array(sorted(set(a)))), _runs(np.array(sorted(set(b))))) for (d1, d2), (a, b) in out.items()]
            columns = list(zip(*items, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2, strict=True)], names=[*content, "runs", "wide"])

    ranges = searched.filter("bucket IS NOT NULL").select("h", "bucket", "strings").repartition(n, "h", "bucket").sortWithinPartitions("h", "bucket")
    none, to_last = F.expr("cast(array() AS array<int>)"), F.array(F.lit(0), F.col("starts") - 1)
    marks = searched.filter("bucket IS NULL").select(*content, "held", "runs", "wide")
    merged = ranges.mapInArrow(merge, "h long, d1 long, d2 long, runs array<int>, wide array<int>").join(marks.select(*content, "held").distinct(), content).select(*marks.columns)
    # Strings of a copied content all repeat; starts too near a text's end to have a string of the full length are left out below.
    wholly = by_content.filter("n > 1").select(*content, F.col("salts").alias("held"), to_last.alias("runs"), F.when(F.col("many"), to_last).otherwise(none).alias("wide"))
    marks = wholly.unionByName(marks).unionByName(merged).filter("size(runs) > 0 OR size(wide) > 0").withColumnRenamed("held", "salts")
    hits = found.join(with_salts(marks, SALTS), ["salt", *content]).select("doc_id", "rid", F.expr("transform(runs, x -> x + lo)").alias("runs"), F.expr("transform(wide, x -> x + lo)").alias("wide"))
    per_doc = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("rid").alias("hit_rid")).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("wide")).alias("wide"))
    per_doc = stored(per_doc, "sa-hits", instead_of=found)
    on = F.col("rid").eqNullSafe(F.col("hit_rid")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))
    hit_rids = per_doc.select(F.col("hit_rid").alias("rid"))
    joined = likely_among(texts, hit_rids, "rid").join(per_doc, on, "left").select("doc_id", "text", "runs", "wide")
    # Most texts hold nothing that repeats: they are not shuffled.
    joined = joined.unionByName(likely_among(texts, hit_rids, "rid", others=True).select("doc_id", "text", none.alias("runs"), none.alias("wide")))

    def covered(runs: list[int] | None, width: int, size: int) -> list[int]:
        """first, end, first, end, ... of what strings of ``width`` at these starts cover."""
        spans: list[int] = []
        for a, b in sorted(zip((runs or [])[::2], (runs or [])[1::2], strict=True)):
            b = min(b, size - width)
            if a > b:
                continue
            if spans and a <= spans[-1]:
                spans[-1] = max(spans[-1], b + width)
            else:
                spans += [a, b + width]
        return spans

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")] + ["spans"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for doc, text, runs, wide in _rows([batch], 4):
                data = (text or "").encode()
                spans = covered(runs, length, len(data))
                kept, at = [], 0
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), len(spans) // 2, sha256(rest).hexdigest(), len(covered(wide, passage, len(data))) // 2, spans))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return joined.mapInArrow(remove, f"{RESULT}, spans array<int>")
