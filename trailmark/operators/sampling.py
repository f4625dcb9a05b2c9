"""Samples of trajectories by ordered strategies (M1 to M10), without picking one twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str = "key", seed: int = 0) -> Column:
    """M3: a keyed order that stands for a random one; any engine with MD5 draws the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def random_keys(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(shuffled(seed=seed), "key").limit(n)


def per_batch(df: DataFrame, batch: str, n: int, seed: int = 0) -> DataFrame:
    """M10."""
    order = Window.partitionBy(batch).orderBy(shuffled(seed=seed), "key")
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def diverse(df: DataFrame, columns: list[str], n: int, clusters: int | None = None, seed: int = 0) -> DataFrame:
    """M4: k-means; then round by round, largest cluster first, the member nearest to its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=columns, outputCol="__v").transform(df.na.fill(0.0, columns))
    model = KMeans(k=clusters or max(2, min(n, 40)), seed=seed, featuresCol="__v", predictionCol="cluster").fit(made)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cluster") + 1)
    gap = F.aggregate(F.zip_with(vector_to_array("__v"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    placed = model.transform(made).withColumn("gap", gap).drop("__v")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("__size"))
    rounds = placed.withColumn("__round", F.row_number().over(Window.partitionBy("cluster").orderBy("gap", "key"))).filter(F.col("__round") <= n)
    return rounds.join(F.broadcast(sizes), "cluster").orderBy("__round", F.desc("__size"), "cluster").limit(n).drop("__round", "__size", "gap")


def extreme(df: DataFrame, column: str, n: int, top: bool = True) -> DataFrame:
    """The highest or lowest by a score."""
    return df.filter(F.col(column).isNotNull()).orderBy(F.desc(column) if top else F.asc(column), "key").limit(n)


def translate(where: str, thresholds: dict[str, float] | None = None) -> str:
    """The frame predicate language in SQL: ``==``, ``&``, ``|``, ``not``, ``{feature.name}``."""
    for name, value in (thresholds or {}).items():
        where = where.replace("{" + name + "}", repr(float(value)))
    return where.replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")


@dataclass
class Strategy:
    """``quota`` is a count, a fraction below 1, or None for the rest; ``kind`` random, diversity, target, outlier or surprise."""

    kind: str
    quota: float | int | None = None
    column: str | None = None
    where: str | None = None
    within: str = "random"
    columns: tuple[str, ...] = ()


def quotas(strategies: list[Strategy], total: int) -> list[int]:
    """M2."""
    made = [None if s.quota is None else int(s.quota * total) if isinstance(s.quota, float) and s.quota < 1 else int(s.quota) for s in strategies]
    rest = max(0, total - sum(q or 0 for q in made))
    open_ = sum(q is None for q in made)
    return [rest // open_ if q is None else q for q in made]


def sample(df: DataFrame, strategies: list[Strategy], total: int, seed: int = 0) -> DataFrame:
    """M1, M6: each strategy picks among what the ones before it left; picks carry strategy and order."""
    picked: DataFrame | None = None
    for i, (s, n) in enumerate(zip(strategies, quotas(strategies, total), strict=True)):
        left = df if picked is None else df.join(picked.select("key"), "key", "left_anti")
        pool = left.filter(translate(s.where)) if s.where else left
        kind = s.within if s.kind == "target" else s.kind
        if kind == "random":
            own = random_keys(pool, n, seed + i)
        elif kind == "diversity":
            own = diverse(pool, list(s.columns), n, seed=seed)
        else:
            own = extreme(pool, s.column, n, kind != "bottom")
        own = own.select("key").withColumn("strategy", F.lit(s.kind)).withColumn("order", F.lit(i))
        picked = own if picked is None else picked.unionByName(own)
    return picked


def top_reasons(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The columns of a row that deviate most, with their deviations."""
    pairs = F.array(*[F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("column"), F.col(c).alias("deviation")) for c in columns])
    present = F.filter(pairs, lambda p: p["size"].isNotNull())
    best = F.slice(F.array_sort(present, lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["column"] < b["column"], -1).otherwise(1)), 1, n)
    return df.withColumn("reasons", F.transform(best, lambda p: F.struct(p["column"].alias("column"), p["deviation"].alias("deviation"))))


def apportion(df: DataFrame, weight: str, name: str, total: int) -> DataFrame:
    """largest remainders, ties by name, nobody above its weight; one row per name, so the order is small."""
    all_ = F.sum(weight).over(Window.partitionBy())
    exact = F.col(weight) * total / all_
    base = df.withColumn("__base", F.least(F.floor(exact), F.col(weight)).cast("long")).withColumn("__rest", exact - F.floor(exact))
    left = F.lit(total) - F.sum("__base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), name))
    return base.withColumn("share", F.least(F.col("__base") + (place <= left).cast("long"), F.col(weight)).cast("long")).drop("__base", "__rest")
