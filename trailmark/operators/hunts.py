"""Iterative searches with probes, and checks of proposed features.

A probe is a SQL query that gives (key, step, note).  Rounds keep a ledger; what is read next comes from hits,
from regions not yet covered and at random.  Answers of readers are given as tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.sqltext import SqlError, bridged, guard
from trailmark.operators.sampling import shuffled
from trailmark.operators.stats import probe_ledger, upper_bound, wilson


@dataclass
class Hunt:
    """H1."""

    reads: int = 60
    hit_share: float = 0.6
    patience: int = 3
    max_rounds: int = 12
    least_reads: int = 3
    least_precision: float = 0.5
    seed: int = 0


@dataclass
class State:
    probes: dict[str, str] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    round: int = 0
    quiet: int = 0
    found: set[str] = field(default_factory=set)
    random_read: int = 0
    random_found: int = 0


def run_probe(spark: SparkSession, name: str, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """H2, H4: distinct (probe, key, step, note); other columns than key, step, note are an error."""
    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    made = bridged(sql)
    guard(spark, made, set(tables))
    out = spark.sql(made)
    if sorted(out.columns) != ["key", "note", "step"]:
        raise SqlError(f"{name} gives {out.columns}, not key, step, note")
    return out.select(F.lit(name).alias("probe"), "key", F.col("step").cast("long").alias("step"), F.col("note").cast("string").alias("note")).dropDuplicates()


def run_probes(spark: SparkSession, probes: dict[str, str], tables: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """H5: hits of all probes, and why some failed."""
    hits, failed = None, {}
    for name, sql in sorted(probes.items()):
        try:
            own = run_probe(spark, name, sql, tables)
            hits = own if hits is None else hits.unionByName(own)
        except SqlError as e:
            failed[name] = str(e)
    return hits, failed


def draw(hits: DataFrame, population: DataFrame, read: DataFrame, hunt: Hunt, round_: int) -> DataFrame:
    """H7, H8: key, source: unread hits first (rarest probe's first), clusters not covered next, the rest at random."""
    unread = population.select("key", "cluster").join(read.select("key"), "key", "left_anti")
    order = shuffled(seed=hunt.seed + round_)
    sizes = hits.select("probe", "key").distinct().groupBy("probe").agg(F.count("*").alias("n"))
    rare = hits.join(sizes, "probe").groupBy("key").agg(F.min("n").alias("n"))
    n_hits = int(hunt.reads * hunt.hit_share)
    first = unread.join(rare, "key").orderBy("n", order, "key").limit(n_hits).select("key", F.lit("hit").alias("source"))
    covered = population.join(read.select("key"), "key", "left_semi").select("cluster").distinct()
    fresh = unread.join(covered, "cluster", "left_anti").join(first, "key", "left_anti").groupBy("cluster").agg(F.min_by("key", order).alias("key"))
    n_cover = (hunt.reads - n_hits) // 2
    second = fresh.orderBy(shuffled("cluster", hunt.seed), "cluster").limit(n_cover).select("key", F.lit("coverage").alias("source"))
    third = unread.join(first.unionByName(second), "key", "left_anti").orderBy(order, "key").limit(hunt.reads - n_hits - n_cover).select("key", F.lit("random").alias("source"))
    return first.unionByName(second).unionByName(third)


def ledger(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """H9: A21 per probe, with the ends of the Wilson interval of its precision."""
    book = probe_ledger(hits, verdicts.select("key", "found"))
    rows = {(r["read"], r["found"]) for r in book.select("read", "found").distinct().collect()}
    bounds = {k: wilson(f, n) for k in rows for n, f in [k]}
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for (n, f), (lo, hi) in bounds.items():
        here = (F.col("read") == n) & (F.col("found") == f)
        low, high = F.when(here, F.lit(lo)).otherwise(low), F.when(here, F.lit(hi)).otherwise(high)
    return book.withColumn("low", low).withColumn("high", high)


def retire(state: State, book: DataFrame, hunt: Hunt) -> State:
    """Probes read often enough whose precision is too low are unproductive."""
    for r in book.collect():
        if r["read"] >= hunt.least_reads and (r["precision"] or 0.0) < hunt.least_precision:
            state.status[r["probe"]] = "unproductive"
    return state


def missed_bound(state: State) -> float:
    """How large the missed share may be, from random reads alone, at 95 %."""
    return upper_bound(state.random_found, state.random_read)


def hunt_rounds(spark: SparkSession, tables: dict[str, DataFrame], population: DataFrame, propose: Callable[[State], dict[str, str]], reader: Callable[[DataFrame], DataFrame], hunt: Hunt | None = None) -> tuple[State, DataFrame]:
    """Propose, run, draw, read, record, until ``patience`` rounds in a row find nothing new.

    ``reader`` turns drawn keys into verdicts (key, found); ``population`` has key and cluster.  A round reads a
    fixed number of trajectories, so verdicts stay small.
    """
    hunt, state = hunt or Hunt(), State()
    verdicts = spark.createDataFrame([], "key string, found boolean, source string, round int")
    while state.round < hunt.max_rounds and state.quiet < hunt.patience:
        new = propose(state)
        state.probes |= new
        state.status |= dict.fromkeys(new, "active")
        hits, failed = run_probes(spark, {n: s for n, s in state.probes.items() if state.status[n] == "active"}, tables)
        state.status |= dict.fromkeys(failed, "failed")
        hits = hits if hits is not None else spark.createDataFrame([], "probe string, key string, step long, note string")
        drawn = draw(hits, population, verdicts, hunt, state.round)
        own = [(r["key"], bool(r["found"]), r["source"], state.round) for r in reader(drawn).join(drawn, "key").select("key", "found", "source").collect()]
        if not own:
            break
        verdicts = verdicts.unionByName(spark.createDataFrame(own, verdicts.schema))
        fresh = {k for k, found, _, _ in own if found} - state.found
        state.found |= fresh
        state.random_read += sum(s == "random" for _, _, s, _ in own)
        state.random_found += sum(s == "random" and f for _, f, s, _ in own)
        state.quiet = 0 if fresh else state.quiet + 1
        state.round += 1
        state = retire(state, ledger(hits, verdicts), hunt)
    return state, verdicts


def closing_order(book: DataFrame) -> DataFrame:
    """Probes by precision, then hits, then name."""
    return book.orderBy(F.desc_nulls_last("precision"), F.desc("hits"), "probe")


def marks(hits: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """Key, facet, step, note of kept probes, the note naming its probe."""
    of = F.create_map(*[F.lit(x) for f, probes in facets.items() for p in probes for x in (p, f)])
    return hits.withColumn("facet", of[F.col("probe")]).filter("facet IS NOT NULL").select("key", "facet", "step", F.concat_ws(": ", "probe", "note").alias("note"))


def is_local(spark: SparkSession, name: str, sql: str, tables: dict[str, DataFrame]) -> bool:
    """Whether a probe gives every trajectory the rows it would get among others: two halves against the whole."""
    whole = run_probe(spark, name, sql, tables)
    halves = None
    for side in (0, 1):
        part = {n: df.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == side) for n, df in tables.items()}
        own = run_probe(spark, name, sql, part)
        halves = own if halves is None else halves.unionByName(own)
    return whole.exceptAll(halves).isEmpty() and halves.exceptAll(whole).isEmpty()


def screen(candidates: dict[str, dict], existing: set[str], capacity: int = 30) -> tuple[dict[str, dict], dict[str, str]]:
    """Proposals that may be tried, and why others may not."""
    good, bad = {}, {}
    for name, spec in candidates.items():
        if not name.isidentifier() or name != name.lower() or "__" in name:
            bad[name] = "a name is lower-case words joined by one underscore"
        elif name in existing:
            bad[name] = "there is such a feature"
        elif spec.get("type") not in ("scalar", "boolean", "category", "set", "vector", "map", "paths", "event"):
            bad[name] = f"unknown type {spec.get('type')}"
        elif len(good) + len(existing) >= capacity:
            bad[name] = "no room"
        else:
            good[name] = spec
    return good, bad


def tail(df: DataFrame, column: str, kind: str, n: int = 12) -> DataFrame:
    """The cases at the tail of a feature: highest scalars, true booleans, rarest labels, most labels or events."""
    if kind == "category":
        counts = df.groupBy(column).agg(F.count("*").alias("__n"))
        return df.join(counts, column).orderBy("__n", "key").limit(n).drop("__n")
    rank = {"scalar": F.col(column), "boolean": F.col(column).cast("int"), "set": F.size(column), "event": F.size(column), "paths": F.size(column), "map": F.size(column), "vector": F.array_max(column) if kind == "vector" else F.lit(0)}[kind]
    return df.filter(F.col(column).isNotNull()).orderBy(F.desc(rank), "key").limit(n)


def code_probe(name: str, tables: dict[str, DataFrame], find: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """A probe written as a function from tables to (key, step, note), held to the same columns as a query."""
    out = find(tables)
    if sorted(out.columns) != ["key", "note", "step"]:
        raise SqlError(f"{name} gives {out.columns}, not key, step, note")
    return out.select(F.lit(name).alias("probe"), "key", F.col("step").cast("long").alias("step"), F.col("note").cast("string").alias("note")).dropDuplicates()


def misplaced(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """H4: hits at steps that their trajectory (key, steps) doesn't have, and of trajectories there are none of."""
    return hits.join(lengths, "key", "left").filter(F.col("steps").isNull() | (F.col("step") < 0) | (F.col("step") >= F.col("steps"))).select("probe", "key", "step")


def verdict_table(hunt: str, readings: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per reading: hunt, key, round, found, facet, and the probes that hit the trajectory, sorted."""
    probes = hits.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("probe")), ",").alias("probes"))
    return readings.join(probes, "key", "left").select(F.lit(hunt).alias("hunt"), "key", "round", "found", "facet", F.coalesce("probes", F.lit("")).alias("probes"))


def confirmed_cases(readings: DataFrame, draws: DataFrame) -> DataFrame:
    """By round and source of the draw: read, found and the share, in the order they were read."""
    both = draws.join(readings, "key")
    return both.groupBy(F.col("round"), "source").agg(F.count("*").alias("read"), F.count_if("found").alias("found"), F.avg(F.col("found").cast("double")).alias("share"))


def tried(probe: DataFrame, readings: DataFrame) -> DataFrame:
    """What a new probe would have hit among what was read: one row of hits, read, found, missed."""
    hit = probe.select("key").distinct().withColumn("hit", F.lit(True))
    joined = readings.select("key", "found").join(hit, "key", "full_outer")
    here = F.coalesce("hit", F.lit(False))
    return joined.agg(F.count_if(here).alias("hits"), F.count_if(here & F.col("found").isNotNull()).alias("read"), F.count_if(here & F.col("found")).alias("found"), F.count_if(~here & F.col("found")).alias("missed"))


def kept_probes(text: str, known: set[str]) -> dict[str, dict]:
    """Kept probes from their JSON text: name -> facet, kind and source; a facet nobody knows is an error."""
    found = json.loads(text)
    for name, probe in found.items():
        if set(probe) != {"facet", "kind", "source"} or probe["kind"] not in ("sql", "code"):
            raise SqlError(f"{name}: a probe has a facet, a kind (sql or code) and a source")
        if probe["facet"] not in known:
            raise SqlError(f"{name}: unknown facet {probe['facet']!r}")
    return dict(sorted(found.items()))
