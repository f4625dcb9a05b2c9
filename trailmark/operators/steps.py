"""Units of a trajectory: turns, windows, chunks, contexts.  Everything is a window over (key, step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_user_message() -> Column:
    """A notice is not one."""
    return (F.col("role") == "user") & (F.col("kind") == "message")


def _upto() -> Window:
    return Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)


def with_turns(steps: DataFrame, cut: int = 4000) -> DataFrame:
    """The running number of user messages (0 before the first), uncut length, content cut."""
    return steps.withColumn("turn", F.sum(is_user_message().cast("long")).over(_upto())).withColumn("chars", F.length("content").cast("long")).withColumn("content", cut_content(F.col("content"), cut))


def cut_content(content: Column, limit: int) -> Column:
    """the first characters, and how many were left out."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(" [... "), (F.length(content) - limit).cast("string"), F.lit(" more characters]"))).otherwise(content)


def trajectories(steps: DataFrame) -> DataFrame:
    """Key, steps, turns."""
    return steps.groupBy("key").agg(F.count("*").alias("steps"), F.count_if(is_user_message()).alias("turns"))


def cut_turns(steps: DataFrame) -> DataFrame:
    """Key, index (from 0), start, end; a turn runs from a user message to the step before the next."""
    last = F.max("step").over(Window.partitionBy("key"))
    own = Window.partitionBy("key").orderBy("step")
    messages = steps.withColumn("last", last).filter(is_user_message())
    return messages.select("key", (F.row_number().over(own) - 1).cast("long").alias("index"), F.col("step").alias("start"), F.coalesce(F.lead("step").over(own) - 1, F.col("last")).alias("end"))


def step_windows(lengths: DataFrame, size: int = 40, stride: int = 20) -> DataFrame:
    """Key, start, end from key, steps; the last window ends with the trajectory."""
    starts = F.when(F.col("steps") <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col("steps") - size, F.lit(stride).cast("long")), F.array(F.col("steps") - size))))
    return lengths.select("key", "steps", F.explode(starts).alias("start")).select("key", "start", (F.least(F.col("start") + size, F.col("steps")) - 1).alias("end"))


def greedy_chunks(steps: DataFrame, limit: int) -> DataFrame:
    """Key, step, chunk; a chunk takes steps while they fit and at least one.

    Sizes of one trajectory are folded in order by an array expression; only (step, chars) is gathered.
    """
    sized = steps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("step", F.length("content").alias("chars")))).alias("s"))
    folded = F.expr(
        f"""aggregate(s, named_struct('size', 0, 'chunk', 0L, 'out', cast(array() AS array<struct<step:bigint,chunk:bigint>>)),
        (a, x) -> named_struct(
            'size', IF(a.size > 0 AND a.size + x.chars > {limit}, x.chars, a.size + x.chars),
            'chunk', IF(a.size > 0 AND a.size + x.chars > {limit}, a.chunk + 1, a.chunk),
            'out', concat(a.out, array(named_struct('step', x.step, 'chunk', IF(a.size > 0 AND a.size + x.chars > {limit}, a.chunk + 1, a.chunk))))),
        a -> a.out)"""
    )
    return sized.select("key", F.explode(folded).alias("x")).select("key", "x.step", "x.chunk")


def last_request(steps: DataFrame) -> DataFrame:
    """For each step, the last user message at or before it."""
    return steps.select("key", "step", F.last(F.when(is_user_message(), F.col("step")), ignorenulls=True).over(_upto()).alias("request"))


def context_before(steps: DataFrame, k: int = 8) -> DataFrame:
    """Key, message, step for the ``k`` steps before each user message; positions make it a window, not a join."""
    own = Window.partitionBy("key").orderBy("step").rowsBetween(-k, -1)
    return steps.withColumn("before", F.collect_list("step").over(own)).filter(is_user_message()).select("key", F.col("step").alias("message"), F.explode("before").alias("step"))


def interjections(steps: DataFrame) -> DataFrame:
    """User messages right after a tool call or result, notices and system steps left out of the order."""
    took_part = steps.filter(~F.col("kind").isin("notice") & (F.col("role") != "system"))
    own = Window.partitionBy("key").orderBy("step")
    return took_part.withColumn("last_kind", F.lag("kind").over(own)).filter(is_user_message() & F.col("last_kind").isin("tool_call", "tool_result")).select("key", "step")


def rendered(steps: DataFrame, cut: int = 4000) -> DataFrame:
    """One markdown text per trajectory, a heading per step, and its SHA-256."""
    heading = F.concat(F.lit("## "), F.col("step").cast("string"), F.lit(" "), F.col("role"), F.lit(" "), F.col("kind"), F.lit("\n\n"), cut_content(F.col("content"), cut))
    texts = steps.select("key", "step", heading.alias("part")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("step", "part"))).alias("parts"))
    text = F.array_join(F.col("parts.part"), "\n\n")
    return texts.select("key", text.alias("markdown"), F.sha2(text, 256).alias("sha256"))


def duration_seconds() -> Column:
    """between the first and the last stamp in step order, where there are two."""
    stamped = F.when(F.col("timestamp").isNotNull(), F.col("step"))
    stamp = F.col("timestamp").cast("timestamp")
    span = F.unix_micros(F.max_by(stamp, stamped)) - F.unix_micros(F.min_by(stamp, stamped))
    return F.when(F.count("timestamp") > 1, span / 1e6)
