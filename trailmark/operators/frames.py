"""Wide tables: features to columns (V1 to V8, V15) and path trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_LABELS = 100


def join_groups(index: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """Every feature group onto the index by key."""
    return reduce(lambda df, group: df.join(group, "key", "left"), groups, index)


def top_labels(df: DataFrame, column: str, limit: int = TOP_LABELS) -> list[str]:
    """The most frequent labels of a category or set, ties by label."""
    kind = dict(df.dtypes)[column]
    label = F.explode(column) if kind.startswith("array") else F.col(column)
    rows = df.select(label.alias("label")).filter("label IS NOT NULL").groupBy("label").count().orderBy(F.desc("count"), "label").limit(limit).collect()
    return [r["label"] for r in rows]


def labels_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The labels a category or set column holds, sorted; a column of more than ``most`` is no category."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    found = sorted(r["label"] for r in df.select(value.alias("label")).filter("label IS NOT NULL").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} labels")
    return found


def one_hot(column: str, labels: list[str]) -> list[Column]:
    """V3: null stays null."""
    return [F.when(F.col(column).isNotNull(), (F.col(column) == x).cast("double")).alias(f"{column}__{x}") for x in labels]


def multi_hot(column: str, labels: list[str]) -> list[Column]:
    """V4."""
    hot = [F.when(F.col(column).isNotNull(), F.array_contains(column, x).cast("double")).alias(f"{column}__{x}") for x in labels]
    return [*hot, F.when(F.col(column).isNotNull(), F.size(column).cast("double")).alias(f"{column}__count")]


def map_columns(column: str, keys: list[str]) -> list[Column]:
    """V5: 0 where the map has no such key, null where there is no map."""
    return [F.when(F.col(column).isNotNull(), F.coalesce(F.col(column)[k].cast("double"), F.lit(0.0))).alias(f"{column}__{k}") for k in keys]


def vector_aggregates(column: str) -> list[Column]:
    """V6, F18."""
    c = F.col(column)
    mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return [F.array_max(c).cast("double").alias(f"{column}__max"), F.array_min(c).cast("double").alias(f"{column}__min"), mean.alias(f"{column}__mean"), F.element_at(c, 1).cast("double").alias(f"{column}__first"), F.element_at(c, -1).cast("double").alias(f"{column}__last")]


def resampled(column: str, points: int) -> Column:
    """a vector at ``points`` evenly spaced places, linear between its values; one value repeats."""
    c, n = f"`{column}`", points
    at = f"(i * (size({c}) - 1) / {max(1, n - 1)}D)"
    lo, hi = f"cast({c}[cast(floor{at} AS INT)] AS DOUBLE)", f"cast({c}[cast(ceil{at} AS INT)] AS DOUBLE)"
    return F.when(F.col(column).isNotNull(), F.expr(f"transform(sequence(0, {n - 1}), i -> {lo} + ({hi} - {lo}) * ({at} - floor{at}))"))


def event_counts(column: str) -> list[Column]:
    """V7: events and those not recovered."""
    return [F.size(column).cast("double").alias(column), F.size(F.filter(column, lambda e: ~e["recovered"])).cast("double").alias(f"{column}__unrecovered")]


def first_unrecovered(events: DataFrame) -> DataFrame:
    """The earliest step, and of equal ones the first rule by name."""
    return events.filter("NOT recovered").groupBy("key").agg(F.min(F.struct("step", "rule")).alias("first")).select("key", "first.step", "first.rule")


def scaled(df: DataFrame, blocks: dict[str, list[str]], labels: set[str] = frozenset(), weights: dict[str, float] | None = None) -> DataFrame:
    """Columns of each block standardised, missing at the mean with a flag, the block's variance its weight squared.

    Blocks of labels stay as they are, missing as 0.
    """
    columns = [c for block in blocks.values() for c in block]
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("sd", F.stddev_pop))], *[F.avg(F.col(c).isNull().cast("double")).alias(f"gone_{c}") for c in columns]).first()
    out: list[Column] = []
    for name, block in blocks.items():
        made, variance = [], 0.0
        for c in block:
            gone = stats[f"gone_{c}"] or 0.0
            if name in labels:
                made.append((c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
                m = (stats[f"avg_{c}"] or 0.0) * (1 - gone)
                variance += ((stats[f"sd_{c}"] or 0.0) ** 2 + (stats[f"avg_{c}"] or 0.0) ** 2) * (1 - gone) - m * m
            else:
                sd = stats[f"sd_{c}"] or 0.0
                made.append((c, F.coalesce((F.col(c).cast("double") - (stats[f"avg_{c}"] or 0.0)) / (sd or 1.0), F.lit(0.0))))
                variance += (1 - gone) if sd else 0.0
        worst = max(stats[f"gone_{c}"] or 0.0 for c in block)
        if worst:
            made.append((f"{name}__missing", F.col(block[0]).isNull().cast("double")))
            variance += (stats[f"gone_{block[0]}"] or 0.0) * (1 - (stats[f"gone_{block[0]}"] or 0.0))
        factor = (weights or {}).get(name, 1.0) / (variance**0.5 or 1.0)
        out += [(e * F.lit(factor)).alias(c) for c, e in made]
    return df.select("key", *out)


# Path trees: ``paths`` has key and path (array of labels), one row per event.


def prefixes(paths: DataFrame, *more: str) -> DataFrame:
    """key, node, depth and ``more``: every beginning of every path, the empty one too."""
    node = F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda d: F.when(d == 0, F.array().cast("array<string>")).otherwise(F.slice("path", 1, d))))
    return paths.select("key", *more, node.alias("node")).withColumn("depth", F.size("node"))


def tree(paths: DataFrame) -> DataFrame:
    """Node, depth, support (trajectories that have it), events.

    Events are counted by key and path before paths are taken apart, and by key and node before keys are counted.
    """
    counted = paths.groupBy("key", "path").agg(F.count("*").alias("n"))
    own = prefixes(counted, "n").groupBy("node", "depth", "key").agg(F.sum("n").alias("n"))
    return own.groupBy("node", "depth").agg(F.count("key").alias("support"), F.sum("n").alias("events"))


def cut_paths(paths: DataFrame, share: float = 0.01) -> DataFrame:
    """Key, node, depth: the longest beginning of each event's path with enough support.

    Support does not grow with depth, so an event's cut is found by looking its beginnings up, distinct paths once.
    """
    n = paths.select("key").distinct().count()
    least = max(1, -(-int(share * n * 1e9) // 10**9))
    kept = tree(paths).filter(F.col("support") >= least).select("node", "depth")
    distinct = paths.groupBy("path").agg(F.count("*").alias("n"))
    begun = distinct.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda d: F.when(d == 0, F.array().cast("array<string>")).otherwise(F.slice("path", 1, d)))))
    cuts = begun.join(kept, "node").groupBy("path").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("depth"))
    return paths.join(cuts, "path").select("key", "node", "depth")


def node_label(levels: int) -> Column:
    """Labels joined, a star above the last level."""
    joined = F.array_join("node", " | ")
    return F.when(F.col("depth") == levels, joined).when(F.col("depth") == 0, "*").otherwise(F.concat(joined, F.lit(" | *")))


def node_shares(cut: DataFrame, levels: int) -> DataFrame:
    """Key, label, share of the trajectory's events at each cut node."""
    total = F.sum("n").over(Window.partitionBy("key"))
    return cut.groupBy("key", node_label(levels).alias("label")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total).select("key", "label", "share")


def rare_share(cut: DataFrame, levels: int) -> DataFrame:
    """V12."""
    return cut.groupBy("key").agg(F.avg((F.col("depth") < levels).cast("double")).alias("rare_share"), F.count("*").alias("events"))


def level_entropy(paths: DataFrame) -> DataFrame:
    """Depth, bits: entropy of the nodes of a depth less that of the depth above."""
    nodes = prefixes(paths).groupBy("depth", "node").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("depth"))
    bits = nodes.withColumn("p", p).groupBy("depth").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return bits.withColumn("bits", F.col("h") - F.coalesce(F.lag("h").over(Window.orderBy("depth")), F.lit(0.0))).filter("depth > 0").select("depth", "bits")


def level_surprisal(paths: DataFrame, reference: DataFrame) -> DataFrame:
    """Key, depth, surprisal: mean over events of -ln((c + 1) / (p + k + 1)), counts from ``reference``.

    c counts a node's events, p its parent's, k the parent's children; below an unknown node nothing is charged.
    """
    nodes = prefixes(reference).groupBy("node", "depth").agg(F.count("*").alias("c"))
    child = nodes.filter("depth > 0").groupBy(F.slice("node", F.lit(1), F.col("depth") - 1).alias("node")).agg(F.count("*").alias("k"))
    parents = nodes.select("node", F.col("c").alias("p")).join(child, "node", "left").select(F.col("node").alias("parent"), "p", F.coalesce("k", F.lit(0)).alias("k"))
    own = prefixes(paths).filter("depth > 0").withColumn("parent", F.slice("node", F.lit(1), F.col("depth") - 1))
    joined = own.join(nodes.select("node", "c"), "node", "left").join(parents, "parent", "left")
    cost = -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("p", F.lit(0)) + F.coalesce("k", F.lit(0)) + 1))
    events = paths.groupBy("key").agg(F.count("*").alias("events"))
    return joined.groupBy("key", "depth").agg(F.sum(cost).alias("total")).join(events, "key").select("key", "depth", (F.col("total") / F.col("events")).alias("surprisal"))
