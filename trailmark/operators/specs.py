"""Typed feature specs, their validation, and answers from a model as tables (1.3, D9, D11, X30 to X37, P5, P7)."""

from __future__ import annotations

import json
import re

from pydantic import BaseModel, ConfigDict, model_validator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS: dict[str, T.DataType] = {
    "scalar": T.DoubleType(),
    "boolean": T.BooleanType(),
    "category": T.StringType(),
    "set": T.ArrayType(T.StringType()),
    "vector": T.ArrayType(T.DoubleType()),
    "map": T.MapType(T.StringType(), T.DoubleType()),
    "paths": T.ArrayType(T.ArrayType(T.StringType())),
    "event": T.ArrayType(T.StructType([T.StructField("step", T.LongType()), T.StructField("recovered", T.BooleanType())])),
}


class Spec(BaseModel):
    """D14."""

    model_config = ConfigDict(extra="forbid")
    name: str
    kind: str
    labels: list[str] | None = None
    range: tuple[float, float] | None = None
    length: int | None = None
    levels: list[str] | None = None
    edge: str | None = None
    scope: str | None = None

    @model_validator(mode="after")
    def _sound(self) -> Spec:
        allowed = {"labels": ("category", "set", "map"), "range": ("scalar",), "length": ("vector",), "levels": ("paths",), "edge": ("event",)}
        if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", self.name):
            raise ValueError("a name is lower-case words joined by one underscore")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        for attribute, kinds in allowed.items():
            if getattr(self, attribute) is not None and self.kind not in kinds:
                raise ValueError(f"{attribute} does not go with {self.kind}")
        if self.range and self.range[0] > self.range[1]:
            raise ValueError("the range is reversed")
        if self.kind == "paths" and not self.levels:
            raise ValueError("paths have levels")
        if self.kind == "event" and not self.edge:
            raise ValueError("an event has an edge")
        return self


def unsound(spec: Spec) -> Column:
    """Whether a non-null value breaks its spec."""
    c = F.col(spec.name)
    listed = F.array(*map(F.lit, spec.labels)) if spec.labels else None
    bad = {
        "scalar": ~c.between(*spec.range) | F.isnan(c) if spec.range else F.isnan(c) if spec.kind == "scalar" else F.lit(False),
        "category": ~F.array_contains(listed, c) if listed is not None and spec.kind == "category" else (F.trim(c) == "" if spec.kind == "category" else F.lit(False)),
        "set": (F.size(F.array_distinct(c)) != F.size(c)) | (F.size(F.array_except(c, listed)) > 0 if listed is not None else F.lit(False)) if spec.kind == "set" else F.lit(False),
        "vector": F.size(c) != spec.length if spec.length else F.lit(False),
        "map": F.size(F.array_except(F.map_keys(c), listed)) > 0 if listed is not None and spec.kind == "map" else F.lit(False),
        "paths": F.exists(c, lambda p: F.size(p) != len(spec.levels or [])) if spec.kind == "paths" else F.lit(False),
    }.get(spec.kind, F.lit(False))
    return c.isNotNull() & bad


def validated(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """One pass over all specs; the first rows that break any stop the run."""
    broken = F.array_compact(F.array(*[F.when(unsound(s), F.lit(s.name)) for s in specs]))
    bad = df.select("key", broken.alias("broken")).filter(F.size("broken") > 0).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['key']}: {', '.join(r['broken'])}" for r in bad))
    return df


def conformed(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """S10, 1.4: a group as its specs want it: a column that is missing or of another type reads as null."""
    have = {f.name: f.dataType for f in df.schema}
    same = lambda a, b: a is not None and a.simpleString() == b.simpleString()
    return df.select("key", *[F.col(s.name) if same(have.get(s.name), KINDS[s.kind]) else F.lit(None).cast(KINDS[s.kind]).alias(s.name) for s in specs])


def scoped(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """P5: out of a feature's scope its value is null, with a detail."""
    from trailmark.operators.sampling import translate

    for s in specs:
        if s.scope:
            inside = F.coalesce(F.expr(translate(s.scope)), F.lit(False))
            df = df.withColumns({s.name: F.when(inside, F.col(s.name)), f"{s.name}__detail": F.when(~inside, F.lit("out of scope"))})
    return df


def answer_schema(specs: list[Spec]) -> str:
    """The JSON schema a model's answer has to meet."""
    kinds = {"scalar": {"type": "number"}, "boolean": {"type": "boolean"}, "category": {"type": "string"}, "set": {"type": "array", "items": {"type": "string"}, "uniqueItems": True}, "vector": {"type": "array", "items": {"type": "number"}}}
    properties = {}
    for s in specs:
        made = json.loads(json.dumps(kinds.get(s.kind, {})))
        if s.labels:
            (made["items"] if s.kind == "set" else made)["enum"] = s.labels
        properties[s.name] = made
    return json.dumps({"type": "object", "properties": properties, "required": sorted(properties), "additionalProperties": False}, sort_keys=True)


def requests(units: DataFrame, instruction: str, specs: list[Spec]) -> DataFrame:
    """units (key, index, start, end, text) with the identity of the question asked of them."""
    asked = F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.lit(answer_schema(specs)).alias("schema"), F.col("text")))
    return units.withColumn("request", F.sha2(asked, 256))


def answered(asked: DataFrame, answers: DataFrame, specs: list[Spec]) -> tuple[DataFrame, DataFrame]:
    """Judgments (key, feature, index, start, end, value, status) of answered requests, and requests still pending.

    ``answers``: request, status, answer (JSON).  A refused or failed answer has a status and no values.
    """
    joined = asked.join(answers, "request", "left")
    pending = joined.filter("status IS NULL").select(*asked.columns)
    values = F.array(*[F.struct(F.lit(s.name).alias("feature"), F.get_json_object("answer", f"$.{s.name}").alias("value")) for s in specs])
    rows = joined.filter("status IS NOT NULL").select("key", "index", "start", "end", "status", F.explode(values).alias("v"))
    value = F.when(F.col("status") == "ok", F.col("v.value"))
    return rows.select("key", "v.feature", "index", "start", "end", value.alias("value"), F.when((F.col("status") == "ok") & value.isNull(), "failed").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("evidence")), pending


def wrong_lengths(judgments: DataFrame, units: DataFrame) -> DataFrame:
    """Trajectories whose answers are not one per unit: key, asked, answered."""
    own = units.groupBy("key").agg(F.count("*").alias("asked"))
    got = judgments.groupBy("key", "feature").agg(F.count("value").alias("answered"))
    return own.join(got, "key", "left").filter(F.coalesce("answered", F.lit(0)) != F.col("asked")).select("key", "feature", "asked", "answered")


def applicable(steps: DataFrame) -> DataFrame:
    """What a trajectory has that features may require."""
    return steps.groupBy("key").agg(F.bool_or((F.col("role") == "user") & (F.col("kind") == "message")).alias("user_messages"), F.bool_or(F.col("kind") == "tool_call").alias("tool_calls"))
