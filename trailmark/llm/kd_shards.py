"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians.

Every document gets a point in a unit cube (size on a log scale, language, source).  The tree has as many leaves as
there are shards: a node that owes k leaves is cut across its widest dimension where the bytes of its sides are as
their leaves ask (the weighted median where both ask for as much), until every leaf is one shard.  Cuts are found by
radix descent: three rounds of histograms over 16-bit digits of a 48-bit key, so a round moves at most 65,536 sums per
node and nothing is sorted or collected.

Copies of a text are one item with one point and one tie-break.  Items so heavy that a cut through them would leave
shards uneven (over 1/32 of a shard; so there are at most 32 a shard) are placed first, the heaviest first, each
where least lies; the tree deals the others, and its leaves ask for what is left to an equal level.  Only a group that
is more than a whole shard is parted, by its salts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import stored

DIMENSIONS = ("size", "lang", "source")
BITS, DIGIT = 24, 16
#: Heavy items are at least this share of a shard, and of everything.
HEAVY, HEAVY_OF_ALL = 1 / 32, 1 / 20_000


def _values(spark, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A small relation made of literals."""
    inner = ", ".join("(" + ", ".join(f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {inner} AS t({', '.join(names)})")


def place_heavy(items: list[tuple[int, ...]], shards: int) -> tuple[list[int], list[int]]:
    """For each of ``items`` (bytes first, the heaviest first) its shard, the emptiest so far; and what each holds then."""
    held = [(0, i) for i in range(shards)]
    placed = []
    for item in items:
        load, shard = heapq.heappop(held)
        placed.append(shard)
        heapq.heappush(held, (load + item[0], shard))
    return placed, [load for load, _ in sorted(held, key=lambda x: x[1])]


def level_up(held: list[int], more: int) -> list[float]:
    """What each shard gets of ``more`` so that all reach one level, as far as they are not over it already."""
    order = sorted(held)
    below = 0
    for n, load in enumerate(order, 1):
        below += load
        level = (below + more) / n
        if n == len(order) or level <= order[n]:
            return [max(0.0, level - x) for x in held]
    return []


def _cuts(items: DataFrame, splits: list[tuple[int, int, float]]) -> dict[int, int]:
    """node -> the key up to which its first ``bytes`` lie; splits: node, dimension, bytes."""
    spark = items.sparkSession
    state = {node: (dim, 0, first) for node, dim, first in splits}
    for shift in (2 * BITS - DIGIT, 2 * BITS - 2 * DIGIT, 0):
        now = _values(spark, ["node", "dim", "prefix"], [(n, d, p) for n, (d, p, _) in state.items()])
        need = _values(spark, ["node", "need"], [(n, max(1, round(x))) for n, (_, _, x) in state.items()])
        key = F.element_at(F.array(*[F.col(f"key_{x}") for x in DIMENSIONS]), (F.col("dim") + 1).cast("int"))
        sums = (
            items.join(F.broadcast(now), "node")
            .select("node", "bytes", "prefix", key.alias("key"))
            .filter(F.expr(f"shiftright(key, {shift + DIGIT}) = prefix"))
            .groupBy("node", F.expr(f"shiftright(key, {shift}) & {2**DIGIT - 1}").alias("digit"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        upto = Window.partitionBy("node").orderBy("digit")
        found = (
            sums.withColumn("cum", F.sum("bytes").over(upto))
            .join(F.broadcast(need), "node")
            .filter("cum >= need")
            .groupBy("node")
            .agg(F.min(F.struct("cum", "digit", "bytes")).alias("at"))
            .collect()
        )
        for row in found:
            dim, prefix, needed = state[row["node"]]
            at, before = row["at"], row["at"]["cum"] - row["at"]["bytes"]
            digit = at["digit"]
            if shift == 0 and before > 0 and at["cum"] - needed > needed - before:
                digit -= 1
            state[row["node"]] = (dim, (prefix << DIGIT) + digit, needed - before)
    return {node: prefix for node, (_, prefix, _) in state.items()}


def kd_shards(
    docs: DataFrame, target_bytes: int | None = None, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_leaves: int = 65_536, slot_rows: int = 20_000
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    There are ``shards`` shards, or as many as leaves of at most ``target_bytes`` need; more than ``max_leaves``
    are refused, which bounds what is broadcast and collected.  Null text counts as empty (size 1); null language
    and source have coordinate 0; a null id is one more id.  An empty table gives no rows, fewer distinct texts than
    shards leave shards empty, and repeated rows are placed like copies.  Slots count from 0 without gaps in each
    shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_key"),
        F.pmod(F.xxhash64(id_col), F.lit(64)).cast("int").alias("salt"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    pieces = rows.groupBy("text_key", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("size"), F.min(F.struct("doc_id", "lang", "source")).alias("first"))
    pieces = stored(pieces, "kd-pieces")
    totals = pieces.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    total, n_rows = totals["bytes"] or 0, totals["rows"] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    if shards > max_leaves:
        raise ValueError(f"{shards} shards are more than {max_leaves}")
    target = max(1.0, total / shards)
    unit = 2**BITS - 1
    point = {
        "size": F.least(F.floor(F.log2(F.col("size").cast("double")) / 40 * unit), F.lit(unit)),
        "lang": F.shiftright(F.coalesce(F.crc32("first.lang"), F.lit(0)), 8),
        "source": F.shiftright(F.coalesce(F.crc32("first.source"), F.lit(0)), 8),
    }
    groups = pieces.groupBy("text_key").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.min("first").alias("first"))
    items = groups.select("text_key", "bytes", *[(F.shiftleft(c.cast("long"), BITS) + F.expr(f"xxhash64(text_key, 3) & {unit}")).alias(f"key_{name}") for name, c in point.items()])
    items = stored(items, "kd-items")
    is_heavy = F.col("bytes") > max(target * HEAVY, total * HEAVY_OF_ALL)
    whole = [(r["bytes"], r["text_key"], -1) for r in items.filter(is_heavy & (F.col("bytes") <= target)).select("bytes", "text_key").collect()]
    huge = items.filter(is_heavy & (F.col("bytes") > target)).select("text_key")
    parted = [(r["bytes"], r["text_key"], r["salt"]) for r in pieces.join(F.broadcast(huge), "text_key").select("bytes", "text_key", "salt").collect()]
    heavy = sorted(whole + parted, key=lambda x: (-x[0], x[1:]))
    placed, held = place_heavy(heavy, shards)
    items = items.filter(~is_heavy).withColumn("node", F.lit(1).cast("long"))
    asked = level_up(held, total - sum(held))
    spans = {1: (0, shards)}  # node -> its leaves; the children of n are 2 n and 2 n + 1
    depth = 0
    while any(end - begin > 1 for begin, end in spans.values()):
        ends = [f(f"key_{x}").alias(f"{n}_{x}") for x in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
        splits, cuts, deeper = [], [], {}
        found = {r["node"]: r for r in items.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect()}
        for node, (begin, end) in spans.items():
            if end - begin == 1:
                deeper[node] = (begin, end)
                continue
            middle = (begin + end) // 2
            deeper |= {2 * node: (begin, middle), 2 * node + 1: (middle, end)}
            if node not in found:
                continue
            row, left, right = found[node], sum(asked[begin:middle]), sum(asked[middle:end])
            widths = [((row[f"hi_{x}"] >> BITS) - (row[f"lo_{x}"] >> BITS), row[f"hi_{x}"] - row[f"lo_{x}"]) for x in DIMENSIONS]
            dim = widths.index(max(widths))
            first = row["bytes"] * left / (left + right) if left + right else 0
            if first < 0.5 or row["bytes"] - first < 0.5:
                cuts.append((node, dim, row[f"hi_{DIMENSIONS[dim]}"] if first >= 0.5 else -1))
            else:
                splits.append((node, dim, first))
        spans = deeper
        keys = _cuts(items, splits) if splits else {}
        cuts += [(n, d, keys[n]) for n, d, _ in splits]
        if cuts:
            by_node = _values(spark, ["node", "dim", "cut"], cuts)
            key = F.element_at(F.array(*[F.col(f"key_{x}") for x in DIMENSIONS]), (F.coalesce(F.col("dim"), F.lit(0)) + 1).cast("int"))
            child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (key > F.col("cut")).cast("long"))
            items = items.join(F.broadcast(by_node), "node", "left").withColumn("node", child).drop("dim", "cut")
        depth += 1
        if depth % 4 == 0:
            items = stored(items, "kd-items")
    numbers = _values(spark, ["node", "shard"], [(n, begin) for n, (begin, _) in spans.items()])
    light = items.join(F.broadcast(numbers), "node").select("text_key", F.lit(-1).cast("long").alias("part"), "shard")
    where = light.unionByName(_values(spark, ["text_key", "part", "shard"], [(k, s, at) for (_, k, s), at in zip(heavy, placed, strict=True)])) if heavy else light
    # A parted group has its salts as parts, any other item is one part.
    keyed = pieces.select("text_key", "salt")
    keyed = keyed.join(F.broadcast(huge.withColumn("huge", F.lit(True))), "text_key", "left").select("text_key", "salt", F.when(F.col("huge"), F.col("salt")).otherwise(-1).cast("long").alias("part"))
    spots = keyed.join(where, ["text_key", "part"]).select("text_key", "salt", F.col("shard").cast("int").alias("shard"))
    buckets = max(1, -(-n_rows // (slot_rows * shards)))
    dealt = rows.select("doc_id", "size", "text_crc32", "text_key", "salt").join(spots, ["text_key", "salt"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    dealt = stored(dealt, "kd-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("at", within).join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
