"""Relations between actions of one trajectory (W9 to W15), as windows over keys and paths.

An action's paths count once each.  Input: key, position, turn, act, program, tool, effect, outcome, paths, text and,
where they exist, subcommand and shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.turns import EDITING, VERIFYING

OBSERVING = ("read", "search", "inspect")
UNDOING = ("checkout", "restore", "stash", "reset", "clean")
_UNRELATED = ("plan", "wait", "ask")


def _filled(actions: DataFrame) -> DataFrame:
    """Columns that a source may lack."""
    for name, kind in (("subcommand", "string"), ("shape", "array<string>")):
        if name not in actions.columns:
            actions = actions.withColumn(name, F.lit(None).cast(kind))
    return actions


def _edges(kind: str, df: DataFrame, earlier: Column) -> DataFrame:
    return df.select("key", F.lit(kind).alias("kind"), F.col("position").alias("later"), earlier.cast("long").alias("earlier"))


def _by_path(actions: DataFrame) -> DataFrame:
    return actions.withColumn("path", F.explode(F.array_distinct("paths")))


def _last_before(column: Column) -> Column:
    own = Window.partitionBy("key", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(column, ignorenulls=True).over(own)


def exact_predecessors(actions: DataFrame) -> DataFrame:
    """Each action with the last one of the same act, program, paths, text and tool."""
    same = Window.partitionBy("key", "act", "program", "subcommand", "paths", "text", "tool").orderBy("position")
    return _filled(actions).withColumn("before", F.lag("position").over(same)).withColumn("before_failed", F.lag(F.col("outcome") == "error").over(same))


def repeats_and_retries(actions: DataFrame) -> DataFrame:
    """A failed exact predecessor is retried, another repeated; without one, a failed act on the same path is retried."""
    related = exact_predecessors(actions).filter(~F.col("act").isin(*_UNRELATED))
    exact = related.filter(F.col("before").isNotNull())
    same_path = Window.partitionBy("key", "act", "path").orderBy("position")
    by_path = _by_path(related).withColumn("last", F.lag("position").over(same_path)).withColumn("last_failed", F.lag(F.col("outcome") == "error").over(same_path))
    return (
        _edges("repeat", exact.filter("NOT before_failed"), F.col("before"))
        .unionByName(_edges("retry", exact.filter("before_failed"), F.col("before")))
        .unionByName(_edges("retry", by_path.filter("before IS NULL AND last_failed"), F.col("last")))
    )


def seen_and_reedited(actions: DataFrame) -> DataFrame:
    """An edit of a path that was observed, or edited, before."""
    by_path = _by_path(actions)
    by_path = by_path.withColumn("seen", _last_before(F.when(F.col("act").isin(*OBSERVING), F.col("position")))).withColumn("edited", _last_before(F.when(F.col("act").isin(*EDITING), F.col("position"))))
    edits = by_path.filter(F.col("act").isin(*EDITING))
    return _edges("seen", edits.filter("seen IS NOT NULL"), F.col("seen")).unionByName(_edges("reedit", edits.filter("edited IS NOT NULL"), F.col("edited")))


def narrowed(actions: DataFrame) -> DataFrame:
    """A partial read of a path read whole before."""
    part = F.coalesce(F.array_contains("shape", "range"), F.lit(False))
    by_path = _by_path(_filled(actions)).withColumn("whole", _last_before(F.when((F.col("act") == "read") & ~part, F.col("position"))))
    return _edges("narrow", by_path.filter((F.col("act") == "read") & part & F.col("whole").isNotNull()), F.col("whole"))


def verified(actions: DataFrame) -> DataFrame:
    """The first test or build after an edit in the same turn, before the path is edited again."""
    test = F.when(F.col("act").isin(*VERIFYING), F.col("position"))
    rest_of_turn = Window.partitionBy("key", "turn").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    with_test = actions.withColumn("test", F.min(test).over(rest_of_turn)).filter(F.col("act").isin(*EDITING))
    next_edit = F.lead("position").over(Window.partitionBy("key", "path").orderBy("position"))
    edits = _by_path(with_test).withColumn("again", next_edit).filter("test IS NOT NULL AND (again IS NULL OR test < again)")
    return edits.select("key", F.lit("verify").alias("kind"), F.col("test").alias("later"), F.col("position").alias("earlier"))


def undone(actions: DataFrame) -> DataFrame:
    """A destructive command of version control on the last edits of all paths, or of those it names or holds."""
    actions = _filled(actions)
    undoing = actions.filter((F.col("act") == "vcs") & (F.col("effect") == "destructive") & F.col("subcommand").isin(*UNDOING)).select("key", F.col("position").alias("later"), F.col("paths").alias("targets"))
    edits = _by_path(actions.filter(F.col("act").isin(*EDITING))).withColumn("again", F.lead("position").over(Window.partitionBy("key", "path").orderBy("position")))
    last = edits.select("key", "path", F.col("position").alias("earlier"), "again").join(undoing, "key").filter("earlier < later AND (again IS NULL OR again > later)")
    hit = (F.size("targets") == 0) | F.array_contains("targets", F.col("path")) | F.exists("targets", lambda t: F.col("path").startswith(F.concat(F.rtrim(t, F.lit("/")), F.lit("/"))))
    return last.filter(hit).select("key", F.lit("undo").alias("kind"), "later", "earlier")


def relations(actions: DataFrame) -> DataFrame:
    """key, kind, later, earlier."""
    parts = [repeats_and_retries(actions), seen_and_reedited(actions), narrowed(actions), verified(actions), undone(actions)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
