"""Trials of proposed features and rounds of proposals (G1, G3 to G5, G9), and the hunts view."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.hunts import screen
from trailmark.operators.review import canonical_value
from trailmark.operators.sampling import shuffled
from trailmark.operators.stats import disagreement


class TrialError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    noise: float = 0.1
    least_varying: float = 0.02
    labels: int = 100
    least_scope: int = 20


def trial_sample(population: DataFrame, chosen: DataFrame, examples: DataFrame, size: int, seed: int = 0, scope: str | None = None, least: int = 20) -> DataFrame:
    """The keys a candidate is tried on: of its scope the chosen ones first, then others by keyed order, without its examples.

    Both parts are at most ``size`` keys, the parameter of the trial.
    """
    inside = population.filter(scope) if scope else population
    if (n := inside.limit(least).count()) < least:
        raise TrialError(f"the scope holds {n} trajectories")
    held = chosen.select("key").join(inside.select("key"), "key", "left_semi").orderBy("key").limit(size)
    left = inside.select("key").join(held.unionByName(examples.select("key")), "key", "left_anti")
    drawn = left.orderBy(shuffled(seed=seed), "key").limit(max(0, size - held.count()))
    return held.withColumn("held_out", F.lit(True)).unionByName(drawn.withColumn("held_out", F.lit(False)))


def trial_figures(first: DataFrame, second: DataFrame, sample: DataFrame, examples: DataFrame, kind: str) -> DataFrame:
    """One row on a candidate's values (key, value): compared, noise, varying, distinct, examples, wrong.

    ``noise`` is the mean disagreement of two answers on the sample, ``varying`` the share of the sample whose value
    isn't the commonest, and ``wrong`` counts the examples whose value isn't the one they state.
    """
    ours = first.select("key", F.col("value").alias("x"))
    pairs = sample.select("key").join(ours, "key").join(second.select("key", F.col("value").alias("y")), "key").filter("x IS NOT NULL AND y IS NOT NULL")
    noise = pairs.agg(F.count("*").alias("compared"), F.avg(disagreement(kind, "x", "y")).alias("noise"))
    texts = sample.select("key").join(ours, "key").filter("x IS NOT NULL").groupBy(canonical_value("x", kind).alias("text")).agg(F.count("*").alias("n"))
    spread = texts.agg((1 - F.max("n") / F.sum("n")).alias("varying"), F.count("*").alias("distinct"))
    stated = examples.select("key", F.col("value").alias("want")).join(ours, "key", "left")
    same = canonical_value("x", kind).eqNullSafe(canonical_value("want", kind)) if kind in ("set", "map") else F.col("x").eqNullSafe(F.col("want"))
    shown = stated.agg(F.count("*").alias("examples"), F.count_if(~same).alias("wrong"))
    return noise.join(F.broadcast(spread)).join(F.broadcast(shown))


def settled(figures: dict, limits: Limits = Limits(), labelled: bool = False, revised: bool = False, judged: bool = True) -> tuple[str, str]:
    """What a trial's figures decide, add, revise or reject, and why; a candidate is revised once."""
    again = "reject" if revised else "revise"
    if not figures["compared"]:
        return "reject", "no value was measured twice"
    if judged and figures["noise"] > limits.noise:
        return again, f"noise {figures['noise']:.4f} is above the limit"
    if figures["wrong"]:
        return again if judged else "reject", f"{figures['wrong']} of {figures['examples']} examples are not reproduced"
    if (figures["varying"] or 0.0) < limits.least_varying:
        return "reject", "it hardly varies"
    if not labelled and judged and figures["distinct"] > limits.labels:
        return again, "more distinct labels than the limit"
    return "add", ""


def computed(name: str, tables: dict[str, DataFrame], operator: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """A feature as a function from tables to (key, value); other columns, and keys that come twice, are an error."""
    out = operator(tables)
    if sorted(out.columns) != ["key", "value"]:
        raise TrialError(f"{name} gives {out.columns}, not key, value")
    if not out.groupBy("key").count().filter("count > 1").isEmpty():
        raise TrialError(f"{name} gives a trajectory two values")
    return out


@dataclass
class Mined:
    accepted: dict[str, dict] = field(default_factory=dict)
    log: list[tuple[int, str, str, str]] = field(default_factory=list)
    rounds: int = 0


def mine(propose: Callable[[Mined], dict[str, dict]], trial: Callable[[str, dict], dict], existing: set[str], capacity: int = 30, most_rounds: int = 10, patience: int = 2, limits: Limits = Limits()) -> Mined:
    """G1: propose, screen, try and settle, until ``patience`` rounds in a row add nothing.

    ``propose`` sees what was accepted and why others were not; ``trial`` gives the figures of a candidate.
    """
    state, quiet, tried_before = Mined(), 0, set()
    while state.rounds < most_rounds and quiet < patience:
        good, bad = screen(propose(state), existing | set(state.accepted), capacity)
        state.log += [(state.rounds, name, "reject", why) for name, why in sorted(bad.items())]
        added = 0
        for name, spec in sorted(good.items()):
            try:
                decision, why = settled(trial(name, spec), limits, bool(spec.get("labels")), name in tried_before)
            except TrialError as e:
                decision, why = "reject", str(e)
            tried_before.add(name)
            state.log.append((state.rounds, name, decision, why))
            if decision == "add":
                state.accepted[name] = spec
                added += 1
        quiet = 0 if added else quiet + 1
        state.rounds += 1
    return state


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, position, column, type and comment of every column of some tables; only schemas are read."""
    rows = [(t, i, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment", "")) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, position int, column string, type string, comment string")


def hunt_rows(verdicts: DataFrame, marks: DataFrame, batches: DataFrame) -> DataFrame:
    """Every trajectory a hunt read (key, found, facet) or its marks (key, facet, step) point to.

    Status is found, rejected or unread; ``marks`` counts a trajectory's marks and ``first_mark`` is the first step.
    """
    pointed = marks.groupBy("key").agg(F.count("*").alias("marks"), F.min("step").alias("first_mark"))
    joined = verdicts.select("key", "found", "facet").join(pointed, "key", "full_outer").join(batches.select("key", "batch"), "key", "left")
    status = F.when(F.col("found").isNull(), "unread").when(F.col("found"), "found").otherwise("rejected")
    return joined.select("key", status.alias("status"), "facet", F.coalesce("marks", F.lit(0)).cast("long").alias("marks"), "first_mark", "batch")


def hunts_list(verdicts: DataFrame) -> DataFrame:
    """Per hunt: rounds, read, found and facets."""
    return verdicts.groupBy("hunt").agg((F.max("round") + 1).alias("rounds"), F.count("*").alias("read"), F.count_if("found").alias("found"), F.count_distinct(F.when(F.col("found"), F.col("facet"))).alias("facets"))
