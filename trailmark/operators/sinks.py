"""Writing tables: replace by key, scoped replace, atomic swaps, exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replaced(old: DataFrame | None, new: DataFrame, covered: DataFrame, scope: tuple[str, list[str]] | None = None) -> DataFrame:
    """K1: ``new`` and those rows of ``old`` whose key is not covered; covered keys lose old rows without new ones too.

    With ``scope`` (K1a), a column and its values, only rows that hold one of the values are replaced.  Old rows
    of another schema are dropped.
    """
    if old is None or {(f.name, f.dataType.simpleString()) for f in old.schema} != {(f.name, f.dataType.simpleString()) for f in new.schema}:
        return new
    keys = covered.select("key").distinct().withColumn("__covered", F.lit(True))
    marked = old.join(keys, "key", "left")
    goes = F.coalesce("__covered", F.lit(False))
    if scope:
        goes = goes & F.coalesce(F.col(scope[0]).isin(scope[1]), F.lit(False))
    return marked.filter(~goes).drop("__covered").select(*new.columns).unionByName(new)


def write_table(new: DataFrame, covered: DataFrame, path: str, scope: tuple[str, list[str]] | None = None) -> None:
    """K1, K3: the replaced table is staged beside its target and swapped in by rename."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else None
    swap(replaced(old, new, covered, scope), path)


def swap(df: DataFrame, path: str) -> None:
    """K3."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.__new")
    fs, target = _fs(spark, path)
    kept = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.__old")
    fs.delete(kept, True)
    if fs.exists(target) and not fs.rename(target, kept):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.__new"), target):
        fs.rename(kept, target)
        raise OSError(f"{path} can't be replaced")
    fs.delete(kept, True)


def feature_rows(long: DataFrame, features: list[str]) -> DataFrame:
    """K2: (key, feature, value, status, detail) to one row per key; features are given, so nothing is collected."""
    return long.groupBy("key").agg(
        *[c for f in features for c in (
            F.max(F.when((F.col("feature") == f) & (F.col("status") == "ok"), F.col("value"))).alias(f),
            F.max(F.when(F.col("feature") == f, F.col("status"))).alias(f"{f}__status"),
            F.max(F.when(F.col("feature") == f, F.col("detail"))).alias(f"{f}__detail"),
        )]
    )


def coverage(long: DataFrame) -> DataFrame:
    """Per feature, rows by status."""
    return long.groupBy("feature").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "refused", "failed", "invalid_length")])


def restricted(df: DataFrame, keys: DataFrame, hidden: list[str] = ()) -> DataFrame:
    """Rows of given keys, hidden metadata fields (globs) left out."""
    kept = df.join(keys.select("key").distinct(), "key", "left_semi")
    if not hidden or "metadata" not in df.columns:
        return kept
    pattern = "^(" + "|".join("".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in h) for h in hidden) + ")$"
    return kept.withColumn("metadata", F.to_json(F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, _: ~k.rlike(pattern))))


def repaired(saved: DataFrame, source: DataFrame) -> DataFrame:
    """The saved rows and the source's missing ones; refuses where a saved row differs from the source."""
    differ = saved.join(source.withColumnRenamed("content", "__source"), ["key", "step"]).filter(~F.col("content").eqNullSafe(F.col("__source"))).limit(5).collect()
    if differ:
        raise ValueError(f"saved rows differ from the source: {[(r['key'], r['step']) for r in differ]}")
    return saved.unionByName(source.join(saved, ["key", "step"], "left_anti").select(*saved.columns))


def arrow(df: DataFrame, most_rows: int = 250_000, most_bytes: int = 128 * 2**20):
    """K8: a result as an Arrow table, refused beyond the caps."""
    table = df.limit(most_rows + 1).toArrow()
    if table.num_rows > most_rows or table.nbytes > most_bytes:
        raise ValueError(f"a result may have {most_rows} rows and {most_bytes} bytes")
    return table


def write_csv(df: DataFrame, path: str) -> None:
    """K6: arrays, maps and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_verdict(spark: SparkSession, path: str, verdict: dict) -> None:
    """One JSON line more; the time of writing orders lines."""
    rows = json.dumps(verdict, sort_keys=True).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"SELECT '{rows}' AS value").coalesce(1).write.mode("append").text(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Key, feature, step, worth, note, at and a line order by time."""
    return spark.read.schema("key string, feature string, step long, worth boolean, note string, at string").json(path).withColumn("line", F.struct("at", "step"))
