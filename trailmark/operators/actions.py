"""Tool calls as actions (T1 to T3, J3): what was done, to which objects, and how it ended."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import objects as O
from trailmark.functions.shell import shell_commands


@dataclass(frozen=True)
class Harness:
    """What an agent's tools do and where their arguments are."""

    acts: dict[str, str] = field(default_factory=lambda: {"Read": "read", "Edit": "edit", "MultiEdit": "edit", "Write": "create", "NotebookEdit": "notebook", "Grep": "search", "Glob": "search", "LS": "inspect", "Task": "delegate", "TodoWrite": "plan", "ExitPlanMode": "plan", "AskUserQuestion": "ask", "WebFetch": "web", "WebSearch": "web", "Skill": "skill"})
    shells: tuple[str, ...] = ("Bash", "bash", "shell", "terminal", "execute_bash")
    path_keys: tuple[str, ...] = ("file_path", "path", "notebook_path", "filename")
    command_keys: tuple[str, ...] = ("command", "cmd", "script")
    text_keys: tuple[str, ...] = ("new_string", "content", "pattern", "query", "prompt")

    def merged(self, **more) -> Harness:
        return replace(self, **{k: {**getattr(self, k), **v} if isinstance(v, dict) else v for k, v in more.items()})


# The effect of an act where no shell command tells more.
EFFECTS = {"edit": "workspace", "create": "workspace", "delete": "destructive", "notebook": "workspace", "read": "none", "search": "none", "inspect": "none", "plan": "none", "ask": "none", "web": "none", "wait": "none", "delegate": "unknown"}


def pairs(steps: DataFrame) -> DataFrame:
    """J3 with nameless results too: key, call, result; a result goes to the earliest open call of its tool, a nameless one to any.

    A fold over one trajectory at a time, of its calls and results only (key, step, kind, name).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: list[tuple[int, str]] = []
        out = []
        for step, kind, name in pdf.sort_values("step")[["step", "kind", "name"]].itertuples(index=False):
            if kind == "tool_call":
                open_.append((step, name or "unnamed"))
                continue
            at = next((i for i, (_, n) in enumerate(open_) if not name or n == name), None)
            if at is not None:
                out.append((pdf.key.iloc[0], open_.pop(at)[0], step))
        out += [(pdf.key.iloc[0], c, None) for c, _ in open_]
        made = pd.DataFrame(out, columns=["key", "call", "result"])
        return made.astype({"call": "Int64", "result": "Int64"})

    own = steps.filter("kind IN ('tool_call', 'tool_result')").select("key", "step", "kind", "name")
    return own.groupBy("key").applyInPandas(fold, "key string, call long, result long")


def actions(steps: DataFrame, harness: Harness | None = None) -> DataFrame:
    """One row per tool call, and per simple command of a shell call, all of which carry the call's outcome.

    ``steps``: key, step, role, kind, name, content, arguments, is_error.
    """
    harness = harness or Harness()
    before = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    numbered = steps.withColumn("turn", F.sum(((F.col("role") == "user") & (F.col("kind") == "message")).cast("long")).over(before))
    results = steps.filter("kind = 'tool_result'").select("key", F.col("step").alias("result"), F.col("content").alias("result_text"), "is_error")
    calls = numbered.filter("kind = 'tool_call'").select("key", F.col("step").alias("call"), "turn", F.coalesce("name", F.lit("unnamed")).alias("tool"), "arguments")
    joined = calls.join(pairs(steps), ["key", "call"]).join(results, ["key", "result"], "left")
    known = F.create_map(*[F.lit(x) for kv in harness.acts.items() for x in kv])
    is_shell = F.col("tool").isin(*harness.shells)
    tool_act = F.coalesce(known[F.col("tool")], F.when(F.col("tool").startswith("mcp__"), "mcp"), F.lit("other"))
    effects = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])
    path = O.first_string(F.col("arguments"), list(harness.path_keys))
    read = joined.withColumn("command", F.when(is_shell, O.first_string(F.col("arguments"), list(harness.command_keys)))).withColumn("path", path).withColumn("text_", O.first_string(F.col("arguments"), list(harness.text_keys)))
    shell = read.filter(is_shell).select("*", F.posexplode(F.when(F.size(shell_commands("command")) > 0, shell_commands("command")).otherwise(F.expr("array(named_struct('program', cast(NULL AS STRING), 'subcommand', cast(NULL AS STRING), 'act', 'shell', 'effect', 'none', 'forced', false, 'join', 'first', 'nesting', cast(array() AS array<string>), 'argv', cast(array() AS array<string>)))"))).alias("ordinal", "c"))
    words = F.filter(F.slice("c.argv", 2, F.greatest(F.size("c.argv") - 1, F.lit(0))), lambda w: w.rlike(r"^[^-].*[./]"))
    base = ["key", "call", "turn", "tool", "result_text", "is_error"]
    one = shell.select(*base, "ordinal", "c.act", "c.program", "c.subcommand", "c.effect", "c.forced", F.when(F.size("c.argv") > 0, words).otherwise(F.array().cast("array<string>")).alias("paths"), F.col("command").alias("text"))
    other = read.filter(~is_shell).select(*base, F.lit(0).alias("ordinal"), tool_act.alias("act"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("subcommand"), F.coalesce(effects[tool_act], F.lit("unknown")).alias("effect"), F.lit(False).alias("forced"), F.when(F.col("path").isNotNull(), F.array("path")).otherwise(F.array().cast("array<string>")).alias("paths"), F.col("text_").alias("text"))
    both = one.unionByName(other).withColumn("o", O.outcome(F.col("result_text"), F.col("act"), F.col("is_error")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("call", "ordinal")) - 1
    return both.select("key", place.cast("long").alias("position"), "call", "ordinal", "turn", "tool", "act", "program", "subcommand", "effect", "forced", "o.outcome", "o.error", "paths", F.transform("paths", lambda p: F.struct(O.object_kind(p).alias("kind"), p.alias("name"), O.file_role(p).alias("role"))).alias("objects"), "text")


def checked_arguments(steps: DataFrame) -> Iterator[str]:
    """calls whose arguments start as a JSON object and are none."""
    bad = steps.filter("kind = 'tool_call'").filter(F.trim("arguments").startswith("{") & F.try_parse_json("arguments").isNull())
    return iter([f"{r['key']} step {r['step']}" for r in bad.select("key", "step").limit(5).collect()])
