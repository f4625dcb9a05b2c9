"""Judged signals (X30 to X37): what is asked of a model, and what its answers come to per trajectory.

A signal names its unit, the features asked, and the aggregates over units.  ``aggregated`` makes all aggregates of a
signal in one pass over its judgments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.specs import Spec

# Labels of the judged features, in the order they are decided in.
REACTIONS = ["failure_report", "rejection", "repeat", "correction", "clarify", "continue", "new_task", "other"]
PUSHBACK = ["correction", "rejection", "failure_report", "repeat"]
END_STATES = ["done", "partial", "abandoned", "unclear"]
FITS = ["yes", "partly", "no"]
EDGES = ["none", "owner", "context", "memory", "tool", "peer", "local_env", "external_env"]
REQUESTS = ["fix", "build", "change", "explain", "write", "operate", "other"]
TURN_LABELS = ["correction", "rejection", "failure_report", "non_pushback"]


@dataclass(frozen=True)
class Aggregate:
    name: str
    of: str
    kind: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Signal:
    unit: str
    specs: tuple[Spec, ...]
    aggregates: tuple[Aggregate, ...] = ()


def _yes(name: str) -> Signal:
    return Signal("trajectory", (Spec(name=name, kind="boolean"),))


SIGNALS: dict[str, Signal] = {
    "signals.user_reaction": Signal(
        "turn",
        (Spec(name="reaction", kind="category", labels=REACTIONS),),
        (
            Aggregate("pushback_share", "reaction", "share", tuple(PUSHBACK)),
            Aggregate("pushbacks", "reaction", "count", tuple(PUSHBACK)),
            Aggregate("failure_reports", "reaction", "count", ("failure_report",)),
            Aggregate("repeats", "reaction", "count", ("repeat",)),
            Aggregate("ended_with", "reaction", "last"),
        ),
    ),
    "signals.end_state": Signal("trajectory", (Spec(name="end_state", kind="category", labels=END_STATES), Spec(name="agent_claims_done", kind="boolean"))),
    "signals.request_fit": Signal(
        "window",
        (Spec(name="request_fit", kind="category", labels=FITS), Spec(name="unfit_edge", kind="category", labels=EDGES)),
        (Aggregate("unfit_share", "request_fit", "share", ("no",)), Aggregate("partly_fit_share", "request_fit", "share", ("partly",))),
    ),
    "task.prompt_intent": Signal("turn", (Spec(name="intent", kind="category", labels=[*REQUESTS, "none"]),), (Aggregate("intents", "intent", "set"), Aggregate("first_intent", "intent", "first"))),
    "task.request_kinds": Signal("trajectory", (Spec(name="request_kinds", kind="set", labels=REQUESTS),)),
    **{f"user.{x}": _yes(f"user_{x}") for x in ("complains", "corrects", "follow_up", "approves")},
    **{f"assistant.{x}": _yes(f"assistant_{x}") for x in ("claims_done", "asks_user")},
}


def configured(features: list[dict]) -> Signal:
    """A signal of a project's own boolean, category and set features over whole trajectories."""
    specs = tuple(Spec(**f) for f in features)
    if odd := [s.name for s in specs if s.kind not in ("boolean", "category", "set")]:
        raise ValueError(f"only booleans, categories and sets can be judged: {odd}")
    return Signal("trajectory", specs)


def _over_units(a: Aggregate) -> Column:
    own = F.col("feature") == a.of
    hit = F.when(own & F.col("value").isNotNull(), F.col("value").isin(*a.values) if a.values else F.lit(True))
    value = F.when(own, F.col("value"))
    made = {
        "share": F.avg(hit.cast("double")),
        "any": F.bool_or(hit),
        "count": F.count_if(hit),
        "first": F.min_by(value, F.when(value.isNotNull(), F.col("index"))),
        "last": F.max_by(value, F.when(value.isNotNull(), F.col("index"))),
        "set": F.array_sort(F.collect_set(value)),
    }
    return made[a.kind].alias(a.name)


def _whole(spec: Spec) -> Column:
    """The answer about a whole trajectory; one that is no label of its spec is left out."""
    value = F.max(F.when(F.col("feature") == spec.name, F.col("value")))
    if spec.kind == "boolean":
        return F.lower(value).try_cast("boolean").alias(spec.name)
    if spec.kind == "set":
        listed = F.array_sort(F.array_distinct(F.from_json(value, "array<string>")))
        return (F.filter(listed, lambda x: x.isin(*spec.labels)) if spec.labels else listed).alias(spec.name)
    return (F.when(value.isin(*spec.labels), value) if spec.labels else value).alias(spec.name)


def aggregated(judgments: DataFrame, signal: Signal) -> DataFrame:
    """One row per key with the aggregates of a signal over units, or its answers about whole trajectories."""
    own = judgments.filter(F.col("feature").isin(*[s.name for s in signal.specs]))
    columns = [_whole(s) for s in signal.specs] if signal.unit == "trajectory" else [_over_units(a) for a in signal.aggregates]
    return own.groupBy("key").agg(*columns)


def turn_label(reaction: Column) -> Column:
    """the turn label that a judged reaction stands for."""
    return F.when(reaction.isin(*TURN_LABELS[:3]), reaction).when(reaction.isNotNull(), TURN_LABELS[3])


def turn_agreement(judgments: DataFrame, labels: DataFrame) -> DataFrame:
    """Judged, label, n over the messages that were judged (feature reaction, start) and labelled (key, step, label)."""
    judged = judgments.filter("feature = 'reaction'").select("key", F.col("start").alias("step"), turn_label(F.col("value")).alias("judged"))
    return judged.join(labels.select("key", "step", "label"), ["key", "step"]).groupBy("judged", "label").agg(F.count("*").alias("n"))


def agreement_of(contingency: DataFrame) -> DataFrame:
    """n, agreement, kappa and the same for pushback against the rest, from ``turn_agreement``; one row."""
    two = lambda c: F.when(F.col(c) == TURN_LABELS[3], c_none).otherwise(c_some)
    c_none, c_some = F.lit("none"), F.lit("pushback")

    def figures(table: DataFrame, suffix: str) -> DataFrame:
        total = table.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("judged") == F.col("label"), F.col("n")).otherwise(0)).alias("same"))
        ours = table.groupBy(F.col("judged").alias("x")).agg(F.sum("n").alias("a"))
        theirs = table.groupBy(F.col("label").alias("x")).agg(F.sum("n").alias("b"))
        chance = ours.join(theirs, "x").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("chance"))
        pe = F.col("chance") / F.col("total") / F.col("total")
        po = F.col("same") / F.col("total")
        return total.join(F.broadcast(chance)).select(F.col("total").alias(f"turns{suffix}"), po.alias(f"agreement{suffix}"), F.when(pe < 1, (po - pe) / (1 - pe)).alias(f"kappa{suffix}"))

    binary = contingency.select(two("judged").alias("judged"), two("label").alias("label"), "n")
    return figures(contingency, "").join(F.broadcast(figures(binary, "_binary").drop("turns_binary")))


def calibration(shown: DataFrame, blind: DataFrame) -> DataFrame:
    """One row on pairs of readings (key, found, facet) of one trajectory, with the hits shown and without."""
    pairs = shown.select("key", F.col("found").alias("s"), F.col("facet").alias("sf")).join(blind.select("key", F.col("found").alias("b"), F.col("facet").alias("bf")), "key")
    both, same = F.col("s") & F.col("b"), F.col("sf").eqNullSafe(F.col("bf"))
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if("s").alias("found_shown"),
        F.count_if("b").alias("found_blind"),
        F.count_if(both).alias("found_both"),
        F.count_if(both & same).alias("same_facet"),
        F.avg(((F.col("s") == F.col("b")) & same).cast("double")).alias("agreement"),
    )


def batch_counts(population: DataFrame, readings: DataFrame, hits: DataFrame) -> DataFrame:
    """Per batch and stratum: trajectories, read, found, found by facet, and hits that nobody read."""
    hit = hits.select("key").distinct().withColumn("hit", F.lit(True))
    joined = population.select("key", "batch", "stratum").join(readings.select("key", "found", "facet"), "key", "left").join(hit, "key", "left")
    by_facet = joined.groupBy("batch", "stratum", F.when(F.col("found"), F.col("facet")).alias("facet")).agg(
        F.count("*").alias("t"), F.count("found").alias("r"), F.count_if("found").alias("f"), F.count_if(F.col("hit") & F.col("found").isNull()).alias("u")
    )
    facets = F.array_sort(F.collect_list(F.when(F.col("facet").isNotNull(), F.struct("facet", "f"))))
    return by_facet.groupBy("batch", "stratum").agg(F.sum("t").alias("trajectories"), F.sum("r").alias("read"), F.sum("f").alias("found"), F.map_from_entries(facets).alias("facets"), F.sum("u").alias("unread_hits"))


def reviewed(readings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """How people's latest verdicts (key, worth, line) agree with what was read: one row."""
    latest = verdicts.groupBy("key").agg(F.max_by("worth", "line").alias("worth"))
    both = readings.select("key", "found").join(latest, "key")
    return both.agg(F.count("*").alias("reviewed"), F.count_if(F.col("found") == F.col("worth")).alias("agreed"), F.count_if(F.col("found") & ~F.col("worth")).alias("overruled"), F.count_if(~F.col("found") & F.col("worth")).alias("missed"))


def surprising(scores: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """M7: the ``n`` trajectories outside the reference set with the highest surprisal (key, surprisal), ranked among those."""
    monitored = scores.join(reference.select("key"), "key", "left_anti").filter(F.col("surprisal").isNotNull())
    of = monitored.count()
    top = monitored.orderBy(F.desc("surprisal"), "key").limit(n)
    place = F.row_number().over(_by_surprisal())
    return top.withColumn("rank", place).withColumn("of", F.lit(of).cast("long"))


def _by_surprisal():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("surprisal"), "key")  # over the picks alone
