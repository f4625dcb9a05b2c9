"""Features of trajectories (X1 to X28) as aggregates over steps, actions and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.objects import file_role

from trailmark.operators.relations import OBSERVING
from trailmark.operators.steps import duration_seconds, is_user_message
from trailmark.operators.turns import EDITING, SIDE_EFFECTS, VERIFYING

SHORT_PROMPT = 20


def basic(steps: DataFrame) -> DataFrame:
    """X1."""
    return steps.groupBy("key").agg(F.count("*").alias("n_steps"), F.count_if(is_user_message()).alias("n_user_turns"), F.sum(F.length("content")).cast("long").alias("total_chars"), (duration_seconds() / 60).alias("duration_minutes"))


def tool_usage(steps: DataFrame) -> DataFrame:
    """Calls, error rate, calls and errors by tool; a nameless tool is ``unnamed``."""
    calls = steps.filter("kind IN ('tool_call', 'tool_result')").withColumn("tool", F.coalesce("name", F.lit("unnamed")))
    by_tool = calls.groupBy("key", "tool").agg(F.count_if(F.col("kind") == "tool_call").alias("calls"), F.count_if("is_error").alias("errors"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("tool", c)))))
    return by_tool.groupBy("key").agg(F.sum("calls").alias("n_tool_calls"), (F.sum("errors") / F.sum("calls")).alias("tool_error_rate"), entries("calls").alias("tool_calls"), entries("errors").alias("tool_errors"))


def dialogue(steps: DataFrame) -> DataFrame:
    """Repeated prompts, share of short prompts after the first, median prompt length."""
    prompts = steps.filter(is_user_message())
    seen = Window.partitionBy("key", F.trim("content")).orderBy("step")
    own = Window.partitionBy("key").orderBy("step")
    marked = prompts.withColumn("nth", F.row_number().over(seen)).withColumn("at", F.row_number().over(own))
    later = F.col("at") > 1
    return marked.groupBy("key").agg(
        F.count_if(F.col("nth") > 1).alias("repeated_prompts"),
        F.avg(F.when(later, (F.length("content") <= SHORT_PROMPT).cast("double"))).alias("short_prompt_share"),
        F.percentile(F.length("content"), 0.5).alias("prompt_chars_median"),
    )


def tool_paths(actions: DataFrame) -> DataFrame:
    """[tool, outcome] per call, in order."""
    return _in_order(actions, F.array("tool", "outcome"), "tool_paths")


def action_paths(actions: DataFrame) -> DataFrame:
    """[act, program, effect, outcome] per action, in order."""
    return _in_order(actions, F.array("act", "program", "effect", "outcome"), "action_paths")


def action_moves(actions: DataFrame) -> DataFrame:
    """[what came before, act, program]; a new turn comes after ``prompt``, the first action after ``start``."""
    own = Window.partitionBy("key").orderBy("position")
    last = F.concat_ws(":", F.lag("act").over(own), F.lag("outcome").over(own))
    after = F.when(F.col("turn") != F.lag("turn", 1, 0).over(own), "prompt").when(F.lag("act").over(own).isNull(), "start").otherwise(last)
    return _in_order(actions.withColumn("after", after), F.array("after", "act", "program"), "action_moves")


def _in_order(actions: DataFrame, value, name: str) -> DataFrame:
    lists = actions.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("position", value.alias("v")))).alias("s"))
    return lists.select("key", F.col("s.v").alias(name))


def paired_calls(steps: DataFrame) -> DataFrame:
    """J3 where every result is named: each result with the earliest open call of its tool, orphans with none.

    A running balance of calls and results per tool tells orphans: a result that makes the balance a new low took
    nothing.  Then the n-th call meets the n-th result that isn't one.
    """
    own = Window.partitionBy("key", "name").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    both = steps.filter("kind IN ('tool_call', 'tool_result')").withColumn("balance", F.sum(F.when(F.col("kind") == "tool_call", 1).otherwise(-1)).over(own))
    lost = F.greatest(F.lit(0), -F.min("balance").over(own))
    both = both.withColumn("lost", lost).withColumn("calls", F.count_if(F.col("kind") == "tool_call").over(own)).withColumn("results", F.count_if(F.col("kind") == "tool_result").over(own))
    before = Window.partitionBy("key", "name").orderBy("step")
    both = both.withColumn("orphan", (F.col("kind") == "tool_result") & (F.col("lost") > F.coalesce(F.lag("lost").over(before), F.lit(0))))
    call = both.filter("kind = 'tool_call'").select("key", "name", F.col("calls").alias("n"), F.col("step").alias("call"))
    result = both.filter("kind = 'tool_result' AND NOT orphan").select("key", "name", (F.col("results") - F.col("lost")).alias("n"), F.col("step").alias("result"))
    return call.join(result, ["key", "name", "n"], "left").select("key", "name", "call", "result")


def action_features(actions: DataFrame, relations: DataFrame) -> DataFrame:
    """X7 to X26 that need no object roles: one row per trajectory with an action."""
    edit, observe, verify = F.col("act").isin(*EDITING), F.col("act").isin(*OBSERVING), F.col("act").isin(*VERIFYING)
    failed, harm = F.col("outcome") == "error", F.col("effect").isin(*SIDE_EFFECTS)
    first_edit = F.min(F.when(edit, F.col("position"))).over(Window.partitionBy("key"))
    own = Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    marked = actions.withColumn("first_edit", first_edit).withColumn("island", F.sum(((F.col("ordinal") == 0) & ~failed).cast("long")).over(own))
    runs = marked.filter((F.col("ordinal") == 0) & failed).groupBy("key", "island").agg(F.count("*").alias("run")).groupBy("key").agg(F.max("run").alias("longest_failure_run"))
    distinct_paths = lambda cond: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(cond, F.col("paths"))))))
    counts = marked.groupBy("key").agg(
        distinct_paths(edit).alias("edited_files"),
        distinct_paths(observe).alias("observed_files"),
        F.count_if(edit).alias("n_edits"),
        F.count_if(failed).alias("n_failed"),
        (F.max(F.when(verify, F.col("position"))) > F.max(F.when(edit, F.col("position")))).alias("late_test"),
        F.max_by(failed, F.when(verify, F.col("position"))).alias("last_verification_failed"),
        F.avg(F.when(verify, failed.cast("double"))).alias("verification_failure_share"),
        F.avg(F.when(F.col("ordinal") == 0, failed.cast("double"))).alias("call_failure_share"),
        F.count_if(harm).alias("side_effects"),
        F.avg(F.when((F.col("position") < F.col("first_edit")), observe.cast("double"))).alias("explore_share"),
        (F.count("*") / F.count_distinct("call")).alias("shell_commands_per_call"),
    )
    of = lambda kind, end: F.count_distinct(F.when(F.col("kind") == kind, F.col(end)))
    related = relations.groupBy("key").agg(of("reedit", "later").alias("reedits"), of("verify", "earlier").alias("verified"), of("retry", "earlier").alias("retried"), of("undo", "later").alias("undo_actions"))
    joined = counts.join(related, "key", "left").join(runs, "key", "left")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.coalesce(part, F.lit(0)) / F.col(whole))
    return joined.select(
        "key", "edited_files", "observed_files",
        share("reedits", "n_edits").alias("reedit_share"),
        share("verified", "n_edits").alias("edit_verified_share"),
        F.when(F.col("n_edits") > 0, F.coalesce("late_test", F.lit(False))).alias("verified_at_end"),
        "last_verification_failed", "verification_failure_share", "call_failure_share",
        share("retried", "n_failed").alias("retry_share"),
        F.coalesce("longest_failure_run", F.lit(0).cast("long")).alias("longest_failure_run"),
        "side_effects", F.coalesce("undo_actions", F.lit(0).cast("long")).alias("undo_actions"), "explore_share", "shell_commands_per_call",
    )


def edited_roles(actions: DataFrame, role: Column | None = None) -> DataFrame:
    """Of a trajectory's edited files, the share that are tests, and that are configuration or lock files."""
    files = actions.filter(F.col("act").isin(*EDITING)).select("key", F.explode(F.array_distinct("paths")).alias("path")).distinct()
    roles = files.withColumn("role", file_role(F.col("path")) if role is None else role)
    return roles.groupBy("key").agg(F.avg((F.col("role") == "test").cast("double")).alias("test_edit_share"), F.avg(F.col("role").isin("config", "lock").cast("double")).alias("config_edit_share"))


def unknown_programs(actions: DataFrame) -> DataFrame:
    """Of the shell commands, those with a program, the share whose program isn't known."""
    return actions.filter("program IS NOT NULL").groupBy("key").agg(F.avg((F.col("act") == "other").cast("double")).alias("unknown_program_share"))


def recovery_share(actions: DataFrame) -> DataFrame:
    """Of the paths that failed, the share whose first failing act later succeeded on them."""
    by_path = actions.withColumn("path", F.explode(F.array_distinct("paths")))
    failed = F.when(F.col("outcome") == "error", F.struct("position", "act"))
    first = by_path.withColumn("first", F.min(failed).over(Window.partitionBy("key", "path"))).filter("first IS NOT NULL")
    later = (F.col("act") == F.col("first.act")) & (F.col("position") > F.col("first.position")) & (F.col("outcome") == "ok")
    return first.groupBy("key", "path").agg(F.bool_or(later).alias("again")).groupBy("key").agg(F.avg(F.col("again").cast("double")).alias("recovery_share"))


def seen_share(actions: DataFrame, relations: DataFrame) -> DataFrame:
    """Of the first edits of each path, the share whose action edits something seen before."""
    first = actions.filter(F.col("act").isin(*EDITING)).withColumn("path", F.explode(F.array_distinct("paths"))).groupBy("key", "path").agg(F.min("position").alias("later")).select("key", "later").distinct()
    seen = relations.filter("kind = 'seen'").select("key", "later", F.lit(1.0).alias("seen")).distinct()
    return first.join(seen, ["key", "later"], "left").groupBy("key").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("edit_seen_share"))


def metadata_fields(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed fields of a JSON text ``metadata``: scalar, boolean, category or set (sorted, distinct)."""
    at = lambda f: F.get_json_object("metadata", f"$.{f}")
    kinds = {"scalar": lambda f: at(f).cast("double"), "boolean": lambda f: at(f).cast("boolean"), "category": at, "set": lambda f: F.array_sort(F.array_distinct(F.from_json(at(f), "array<string>")))}
    return rows.select("key", *[kinds[kind](f).alias(f) for f, kind in fields.items()])


def judged(judgments: DataFrame, feature: str, kind: str, of: list[str] | None = None) -> DataFrame:
    """A10: one value per key over its judged units in order: share, any, count, mean, first, last or set.

    ``of`` are the answers that count; booleans are compared as lower-case text.
    """
    own = judgments.filter(F.col("feature") == feature)
    value = F.lower("value") if kind in ("share", "any", "count") else F.col("value")
    hit = value.isin([v.lower() for v in of]) if of else value.isNotNull()
    kinds = {
        "share": F.avg(hit.cast("double")),
        "any": F.bool_or(hit),
        "count": F.count_if(hit),
        "mean": F.avg(F.col("value").cast("double")),
        "first": F.min_by("value", "index"),
        "last": F.max_by("value", "index"),
        "set": F.array_sort(F.collect_set("value")),
    }
    return own.groupBy("key").agg(kinds[kind].alias(feature))
