"""Command line: the verbs of a trajectory project over a folder of tables.  Exit codes: 0 done, 1 refused, 2 misused."""

from __future__ import annotations

import argparse
import json
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _ingest(spark, a) -> dict:
    from trailmark.operators import sinks, steps
    from trailmark.sources.adapters import ADAPTERS, checked

    parsed = checked(ADAPTERS[a.adapter](spark, a.paths, a.dataset))
    made = steps.with_turns(parsed)
    sinks.write_table(made, made.select("key"), f"{a.tables}/steps.parquet")
    return {"trajectories": parsed.select("key").distinct().count()}


def _table(spark, a):
    df = spark.read.parquet(f"{a.tables}/{a.name}.parquet")
    missing = sorted(set(a.columns) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*(a.columns or df.columns)).limit(a.limit)


def _query(spark, a):
    from trailmark.functions.sqltext import run_query

    names = a.names or ["steps"]
    return run_query(spark, a.sql, {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in names}, a.limit)


def _features(spark, a):
    from trailmark.operators import features

    steps = spark.read.parquet(f"{a.tables}/steps.parquet")
    return features.basic(steps).join(features.dialogue(steps), "key", "left")


def _sample(spark, a):
    from trailmark.operators.sampling import Strategy, sample

    return sample(_features(spark, a), [Strategy(**s) for s in json.loads(a.strategies)], a.total, a.seed)


def _tree(spark, a):
    from pyspark.sql import functions as F

    from trailmark.operators.frames import tree

    paths = spark.read.parquet(f"{a.tables}/{a.name}.parquet").select("key", F.explode(a.column).alias("path"))
    return tree(paths).orderBy("depth", F.desc("support")).limit(a.limit)


VERBS = {"ingest": _ingest, "table": _table, "query": _query, "extract": _features, "sample": _sample, "tree": _tree}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in VERBS:
        s = sub.add_parser(verb)
        s.add_argument("--tables", required=True)
        s.add_argument("--limit", type=int, default=200)
        if verb == "ingest":
            s.add_argument("--adapter", default="messages")
            s.add_argument("--dataset", required=True)
            s.add_argument("paths", nargs="+")
        if verb in ("table", "tree"):
            s.add_argument("name")
        if verb == "table":
            s.add_argument("columns", nargs="*")
        if verb == "tree":
            s.add_argument("column")
        if verb == "query":
            s.add_argument("sql")
            s.add_argument("--names", nargs="*")
        if verb == "sample":
            s.add_argument("--strategies", default='[{"kind": "random"}]')
            s.add_argument("--total", type=int, default=50)
            s.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        out = VERBS[a.verb](session(), a)
    except (ValueError, OSError) as e:
        print(f"trailmark: {e}", file=sys.stderr)
        return 1
    if isinstance(out, dict):
        print(json.dumps(out))
    else:
        print(out.toPandas().to_csv(index=False), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
