"""What a reviewer asks of the tables (R1 to R13, P8 to P12, O1 to O10): each is one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.events import events_in_turns
from trailmark.operators.stats import quantiles


def page(df: DataFrame, sort: str, key: str, size: int, number: int = 0, descending: bool = True) -> DataFrame:
    """O1, R2: one page in a total order, nulls last, ties by key."""
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(order, key).offset(size * number).limit(size)


def search(df: DataFrame, text: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold ``text`` anywhere, and each column its own text, without regard to case."""
    if text:
        whole = F.concat_ws(" ", *[F.col(c).cast("string") if not t.startswith(("array", "map", "struct")) else F.to_json(c) for c, t in df.dtypes])
        df = df.filter(F.contains(F.lower(whole), F.lit(text.lower())))
    for c, wanted in (columns or {}).items():
        df = df.filter(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted.lower())))
    return df


def having(df: DataFrame, *others: DataFrame, without: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Rows whose key is in every one of ``others`` and in none of ``without``."""
    for o in others:
        df = df.join(o.select("key").distinct(), "key", "left_semi")
    for o in without:
        df = df.join(o.select("key").distinct(), "key", "left_anti")
    return df


def having_any(df: DataFrame, *others: DataFrame) -> DataFrame:
    """P10: the keys of several EXISTS conditions, any of which will do."""
    keys = others[0].select("key")
    for o in others[1:]:
        keys = keys.unionByName(o.select("key"))
    return df.join(keys.distinct(), "key", "left_semi")


def first_per_key(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """W20."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def last_judgment(judgments: DataFrame) -> DataFrame:
    """The last unit of each feature of each trajectory."""
    return judgments.groupBy("key", "feature").agg(F.max(F.struct("index", "value")).alias("last")).select("key", "feature", "last.index", "last.value")


def strongest(shifts: DataFrame, by: str = "feature") -> DataFrame:
    """W22."""
    order = Window.partitionBy(by).orderBy(F.desc(F.abs("effect")), "column")
    return shifts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def expanded(df: DataFrame, column: str) -> DataFrame:
    """Key, label, value of a set, vector (labels from 0), map or paths feature."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("map"):
        return df.select("key", F.explode(column).alias("label", "value")).withColumn("value", F.col("value").cast("double"))
    if kind == "array<string>":
        return df.select("key", F.explode(column).alias("label")).withColumn("value", F.lit(1.0))
    if kind.startswith("array<array"):
        return df.select("key", F.explode(column).alias("p")).select("key", F.array_join("p", " | ").alias("label"), F.lit(1.0).alias("value"))
    return df.select("key", F.posexplode(column).alias("at", "value")).select("key", F.col("at").cast("string").alias("label"), F.col("value").cast("double").alias("value"))


def compared(df: DataFrame, group: str, measure: str | None = None, how: str = "count", split: str | None = None, splits: list | None = None) -> DataFrame:
    """A3: a bar per group: count, sum or mean; a column per value of ``split``."""
    value = {"count": F.count("*"), "sum": F.sum(measure or F.lit(1)), "mean": F.avg(measure or F.lit(1))}[how].alias("value")
    grouped = df.groupBy(group)
    return (grouped.pivot(split, splits) if split else grouped).agg(value)


def groupings(rows: DataFrame) -> DataFrame:
    """How many trajectories have each metadata field, and its distinct values."""
    fields = rows.select("key", F.explode(F.from_json("metadata", "map<string,string>")).alias("field", "value"))
    return fields.groupBy("field").agg(F.count("*").alias("trajectories"), F.count_distinct("value").alias("distinct_values"))


def trajectory_list(anomalies: DataFrame, stats: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Anomalies with turn statistics and sizes."""
    return trajectories.join(anomalies, "key", "left").join(stats, "key", "left")


def course(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Each turn with the marks (key, step, label) that fall into it, in order."""
    found = events_in_turns(marks.withColumnRenamed("label", "rule"), turns).filter("`index` IS NOT NULL")
    listed = found.groupBy("key", "index").agg(F.sort_array(F.collect_list(F.struct("step", F.col("rule").alias("label")))).alias("marks"))
    none = F.array().cast("array<struct<step:bigint,label:string>>")
    return turns.select("key", "index", "start", "end").join(listed, ["key", "index"], "left").withColumn("marks", F.coalesce("marks", none))


def cards(features: DataFrame, *more: DataFrame) -> DataFrame:
    """One row per feature, joined with its figures."""
    for df in more:
        features = features.join(df, "feature", "left")
    return features


def typical(df: DataFrame, batch: str, column: str, kind: str) -> DataFrame:
    """Median of a scalar, mean of a boolean, or the most frequent label, ties to the smallest."""
    if kind == "category":
        counts = df.filter(F.col(column).isNotNull()).groupBy(batch, F.col(column).alias("label")).agg(F.count("*").alias("n"))
        return counts.groupBy(batch).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("typical"))
    if kind == "boolean":
        return df.groupBy(batch).agg(F.avg(F.col(column).cast("double")).alias("typical"))
    return df.select(batch).distinct().join(quantiles(df, [batch], column, {"typical": 0.5}), batch, "left")


def complete(frame: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """Trajectories with a row, of any status, in every group."""
    return having(frame, *groups)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def selected(index: DataFrame, keys: list[str] | None = None, datasets: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The index (key, dataset, place) by given keys, by datasets and to the first ``limit`` in its order; unknown keys are an error."""
    found = index
    if keys is not None:
        wanted = index.sparkSession.createDataFrame([(k,) for k in keys], "key string")
        if lost := [r["key"] for r in wanted.join(index, "key", "left_anti").orderBy("key").limit(5).collect()]:
            raise ValueError(f"unknown keys {lost}")
        found = found.join(F.broadcast(wanted.distinct()), "key", "left_semi")
    if datasets is not None:
        found = found.filter(F.col("dataset").isin(*datasets))
    return found.orderBy("place", "key").limit(limit) if limit is not None else found


def context_frame(index: DataFrame, categories: DataFrame, batches: DataFrame) -> DataFrame:
    """What an anomaly is seen against: dataset, the context categories, batch and stratum of a trajectory."""
    return index.select("key", "dataset").join(categories, "key", "left").join(batches.select("key", "batch", "stratum"), "key", "left")


def attached(view: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns (key, ...) beside a query view; a name that is there already is an error, and every row stays."""
    if twice := sorted((set(view.columns) & set(columns.columns)) - {"key"}):
        raise ValueError(f"columns that are there already: {twice}")
    return view.join(columns, "key", "left")


def canonical_value(column: str, kind: str) -> Column:
    """a value as text by which equal values are equal; a set's order doesn't matter, nor a map's."""
    if kind == "set":
        return F.to_json(F.array_sort(F.array_distinct(column)))
    if kind == "map":
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    return F.to_json(F.struct(F.col(column).alias("v")))


def distinct_values(df: DataFrame, column: str, kind: str) -> DataFrame:
    """A15."""
    return df.filter(F.col(column).isNotNull()).agg(F.count_distinct(canonical_value(column, kind)).alias("distinct_values"))


def measured(*features: DataFrame) -> DataFrame:
    """Keys that every feature measured (key, status)."""
    out = None
    for df in features:
        own = df.filter("status = 'ok'").select("key").distinct()
        out = own if out is None else out.join(own, "key", "left_semi")
    return out


def reference_set(index: DataFrame, datasets: list[str], excluded: DataFrame) -> DataFrame:
    """P12."""
    return index.filter(F.col("dataset").isin(*datasets)).join(excluded.select("key"), "key", "left_anti")
