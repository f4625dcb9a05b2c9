"""Rules that find broken expectations in a sequence of actions or turns (E1 to E6), with their recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.relations import repeats_and_retries
from trailmark.operators.turns import SIDE_EFFECTS

#: Rules about the consequence itself: they get no lift.
CONSEQUENCE_RULES = ("interrupted_at_plan", "interrupted_without_output")


def recoveries(actions: DataFrame, broken: DataFrame) -> DataFrame:
    """``broken`` (key, position) with the first later action of its act, ok, that shares a path, or any if it has none.

    One pass per (key, act, path): the next ok action of a path is a window, not a self-join over all later ones.
    """
    later = Window.partitionBy("key", "act", "path").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    paths = F.when(F.size("paths") > 0, F.concat(F.array_distinct("paths"), F.array(F.lit("*")))).otherwise(F.array(F.lit("*")))
    by_path = actions.withColumn("path", F.explode(paths)).withColumn("next_ok", F.min(F.when(F.col("outcome") == "ok", F.col("position"))).over(later))
    own = by_path.filter((F.size("paths") == 0) | (F.col("path") != "*")).groupBy("key", "position").agg(F.min("next_ok").alias("recovered_position"))
    calls = actions.select("key", F.col("position").alias("recovered_position"), F.col("call").alias("recovered_at"))
    return broken.join(own, ["key", "position"], "left").join(calls, ["key", "recovered_position"], "left")


def _event(rule: str, df: DataFrame) -> DataFrame:
    return df.select("key", F.lit(rule).alias("rule"), F.col("call").alias("step"), F.col("recovered_at").isNotNull().alias("recovered"), "recovered_at")


def unanswered(actions: DataFrame) -> DataFrame:
    """E1."""
    broken = actions.filter("ordinal = 0 AND outcome = 'unanswered'").select("key", "position", "call")
    return _event("result_unanswered", recoveries(actions, broken))


def blind_retries(actions: DataFrame) -> DataFrame:
    """A retry with the text and paths of what failed."""
    retries = repeats_and_retries(actions).filter("kind = 'retry'").select("key", F.col("later").alias("position"), "earlier")
    own = actions.select("key", "position", "call", "text", "paths")
    first = actions.select("key", F.col("position").alias("earlier"), F.col("text").alias("text_0"), F.col("paths").alias("paths_0"))
    blind = retries.join(own, ["key", "position"]).join(first, ["key", "earlier"]).filter(F.col("text").eqNullSafe(F.col("text_0")) & (F.array_sort("paths") == F.array_sort("paths_0")))
    return _event("blind_retry", recoveries(actions, blind.select("key", "position", "call").distinct()))


def unasked_side_effects(actions: DataFrame) -> DataFrame:
    """A side effect when the last thing in the turn that counts, a question or a side effect, was one."""
    before = Window.partitionBy("key", "turn").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    harm = F.col("effect").isin(*SIDE_EFFECTS)
    mark = F.when(F.col("act") == "ask", F.lit(False)).when(harm, F.lit(True))
    found = actions.withColumn("last", F.last(mark, ignorenulls=True).over(before)).filter(harm & F.col("last"))
    return found.select("key", F.lit("side_effect_unasked").alias("rule"), F.col("call").alias("step"), F.lit(False).alias("recovered"), F.lit(None).cast("long").alias("recovered_at"))


def failure_runs(actions: DataFrame, run: int = 3) -> DataFrame:
    """The call that completes ``run`` failures in a row; any later ok call recovers it."""
    own = Window.partitionBy("key").orderBy("position")
    calls = actions.filter("ordinal = 0").withColumn("failed", F.col("outcome") == "error")
    calls = calls.withColumn("island", F.sum((~F.col("failed")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    after = own.rowsBetween(1, Window.unboundedFollowing)
    calls = calls.withColumn("recovered_at", F.first(F.when(F.col("outcome") == "ok", F.col("call")), ignorenulls=True).over(after))
    in_run = F.sum(F.col("failed").cast("long")).over(Window.partitionBy("key", "island").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return _event("failure_run", calls.withColumn("nth", in_run).filter(F.col("failed") & (F.col("nth") == run)))


def interrupted_turns(turns: DataFrame) -> DataFrame:
    """E5, E6."""
    cut = turns.filter("ended_by = 'interrupt'")
    at_plan = cut.filter(F.col("last_act").isin("plan", "ask")).withColumn("rule", F.lit("interrupted_at_plan"))
    empty = cut.filter("edits = 0 AND verifications = 0 AND messages = 0").withColumn("rule", F.lit("interrupted_without_output"))
    return at_plan.unionByName(empty).select("key", "rule", F.col("start").alias("step"), F.lit(False).alias("recovered"), F.lit(None).cast("long").alias("recovered_at"))


def all_events(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """key, rule, step, recovered, recovered_at."""
    out = unanswered(actions)
    for part in (blind_retries(actions), unasked_side_effects(actions), failure_runs(actions), interrupted_turns(turns)):
        out = out.unionByName(part)
    return out


def judged_events(judgments: DataFrame, feature: str, values: list[str]) -> DataFrame:
    """Units whose answer is one of ``values``."""
    hit = judgments.filter((F.col("feature") == feature) & F.col("value").isin(*values))
    return hit.select("key", F.lit(feature).alias("rule"), F.col("start").alias("step"), "end", F.col("evidence").alias("note"))


def events_in_turns(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Events with the turn that contains their step; an as-of look-up over both, in one sort by step."""
    starts = turns.select("key", F.col("start").alias("at"), F.lit(0).alias("order"), "index", "start", "end", F.lit(None).cast("string").alias("rule"))
    marks = events.select("key", F.col("step").alias("at"), F.lit(1).alias("order"), F.lit(None).cast("long").alias("index"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "rule")
    upto = Window.partitionBy("key").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(marks).withColumn("last", F.last(F.when(F.col("order") == 0, F.struct("index", "start", "end")), ignorenulls=True).over(upto))
    return both.filter("`order` = 1").select("key", "rule", F.col("at").alias("step"), F.when(F.col("at") <= F.col("last.end"), F.col("last.index")).alias("index"))
