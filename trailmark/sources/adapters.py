"""Readers of raw conversation files into trajectories and steps.

A file is split into records by Spark; a record is parsed by one Python function per format, since its parts are
irregular.  Parsers yield steps or raise; a failed record becomes a violation row, and ``checked`` stops a run on
the first few, so a bad file is found wherever it is read.
"""

from __future__ import annotations

import ast
import hashlib
import importlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_FIELDS = ("role", "kind", "name", "content", "arguments", "is_error", "timestamp")
PARSED = pa.schema(
    [("dataset", pa.string()), ("id", pa.string()), ("metadata", pa.string()), ("step", pa.int64())]
    + [(f, pa.bool_() if f == "is_error" else pa.string()) for f in STEP_FIELDS]
    + [("violation", pa.string())]
)
PARSED_DDL = "dataset string, id string, metadata string, step long, role string, kind string, name string, content string, arguments string, is_error boolean, timestamp string, violation string"

# How public chat formats name the four roles.
ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "tool": "tool", "function": "tool"}
# Keys a message may have.
MESSAGE_KEYS = {"role", "content", "name", "tool_calls", "tool_call_id", "tool_call_ids", "function_call", "reasoning_content", "refusal", "audio"}
# Parts that hold no text.
MEDIA = {"image_url": "[image]", "image": "[image]", "input_audio": "[audio]", "audio": "[audio]", "file": "[file]", "document": "[document]", "video": "[video]"}


class Violation(ValueError):
    pass


def safe_id(text: str) -> str:
    """S9, F1."""
    made = re.sub(r"[^A-Za-z0-9._-]", "_", text)[:120]
    if not made:
        raise Violation("an empty id")
    return made


@dataclass
class Messages:
    """Options of the chat message reader; the defaults fit role/content messages under ``messages``."""

    messages_key: str = "messages"
    role_key: str = "role"
    content_key: str = "content"
    id_key: str | None = None
    metadata_keys: tuple[str, ...] = ()
    ignore_keys: tuple[str, ...] = ()
    messages_encoding: str = "object"
    call_format: str = "json"
    call_role: str | None = None
    roles: dict[str, str] = field(default_factory=lambda: dict(ROLES))
    skip_empty: bool = False

    def steps(self, record: dict) -> list[dict]:
        messages = record.get(self.messages_key)
        if isinstance(messages, str) or self.messages_encoding == "json":
            messages = json.loads(messages)
        if not messages:
            if self.skip_empty:
                return []
            raise Violation("no messages")
        out: list[dict] = []
        names: dict[str, str] = {}
        for message in messages:
            out += self._message(message, names)
        return out

    def _message(self, message: dict, names: dict[str, str]) -> Iterator[dict]:
        known = MESSAGE_KEYS | {self.role_key, self.content_key} | set(self.ignore_keys)
        unknown = sorted(k for k, v in message.items() if v is not None and k not in known)
        if unknown:
            raise Violation(f"unknown keys {unknown}")
        said = message.get(self.role_key)
        content = message.get(self.content_key)
        if self.call_role and said == self.call_role:
            call = ast.literal_eval(content) if self.call_format == "python" else json.loads(content)
            yield _step("assistant", "tool_call", name=call.get("name"), arguments=_json(call.get("arguments")))
            return
        role = self.roles.get(said)
        if role is None:
            raise Violation(f"unknown role {said!r}")
        if message.get("reasoning_content"):
            yield _step(role, "thinking", message["reasoning_content"])
        if role == "tool":
            yield _step("tool", "tool_result", _flat(content), name=self._result_name(message, names))
        else:
            yield from self._parts(role, content, names)
        if message.get("refusal"):
            yield _step(role, "message", message["refusal"])
        if message.get("audio"):
            yield _step(role, "message", (message["audio"] or {}).get("transcript") or MEDIA["audio"])
        if message.get("function_call"):
            call = message["function_call"]
            yield _step(role, "tool_call", name=call.get("name"), arguments=_json(call.get("arguments")))
        for call in message.get("tool_calls") or []:
            function = call.get("function", call)
            if call.get("id"):
                names[call["id"]] = function.get("name")
            yield _step(role, "tool_call", name=function.get("name"), arguments=_json(function.get("arguments")))

    @staticmethod
    def _result_name(message: dict, names: dict[str, str]) -> str | None:
        """S4d: the called tool, by id; several ids give their distinct names in order."""
        ids = message.get("tool_call_ids") or ([message["tool_call_id"]] if message.get("tool_call_id") else [])
        found = list(dict.fromkeys(n for n in map(names.get, ids) if n))
        return ",".join(found) or message.get("name")

    @staticmethod
    def _parts(role: str, content, names: dict[str, str]) -> Iterator[dict]:
        """Text parts side by side are one message; other parts are steps of their own."""
        if content is None or isinstance(content, str):
            if content:
                yield _step(role, "message", content)
            return
        text: list[str] = []
        for part in content:
            kind = "text" if isinstance(part, str) else part.get("type", "text")
            if kind in ("text", "input_text", "output_text") or kind in MEDIA:
                text.append(part if isinstance(part, str) else MEDIA.get(kind) or part.get("text", ""))
                continue
            if text:
                yield _step(role, "message", "\n".join(text))
                text = []
            if kind == "thinking":
                yield _step(role, "thinking", part.get("thinking", ""))
            elif kind == "tool_use":
                names[part.get("id", "")] = part.get("name")
                yield _step("assistant", "tool_call", name=part.get("name"), arguments=_json(part.get("input")))
            elif kind == "tool_result":
                yield _step("tool", "tool_result", _flat(part.get("content")), name=names.get(part.get("tool_use_id", "")), is_error=bool(part.get("is_error")))
            else:
                raise Violation(f"unknown part {kind!r}")
        if text:
            yield _step(role, "message", "\n".join(text))


def _step(role: str, kind: str, content: str = "", **more) -> dict:
    return {"role": role, "kind": kind, "content": content or "", "name": None, "arguments": None, "is_error": None, "timestamp": None} | more


def _json(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _flat(content) -> str:
    """The text of a tool's result, whose blocks may be text or media."""
    if content is None or isinstance(content, str):
        return content or ""
    return "\n".join(x if isinstance(x, str) else MEDIA.get(x.get("type")) or x.get("text", "") for x in content)


@dataclass
class Session:
    """A coding session as lines of typed events, in file order."""

    keep_sidechains: bool = False
    least_user_turns: int = 0
    interruption: str = "[Request interrupted by user"

    def steps(self, lines: list[dict]) -> list[dict]:
        reader, names, out = Messages(), {}, []
        for line in lines:
            if line.get("type") not in ("user", "assistant") or (line.get("isSidechain") and not self.keep_sidechains) or line.get("isMeta"):
                continue
            message = line.get("message") or {}
            human = (line.get("origin") or {}).get("kind", "human") == "human"
            for step in reader._parts(message.get("role", line["type"]), message.get("content"), names):
                if step["kind"] == "message" and step["role"] == "user":
                    if step["content"].startswith(self.interruption):
                        step |= {"kind": "notice", "name": "interruption"}
                    elif not human or re.match(r"<(command-name|local-command)", step["content"]):
                        step["role"] = "system"
                out.append(step | {"timestamp": line.get("timestamp")})
        if sum(s["role"] == "user" and s["kind"] == "message" for s in out) < self.least_user_turns:
            return []
        return out


def atif_documents(document: dict, parent: str | None = None) -> Iterator[tuple[str, dict, list[dict]]]:
    """(id, metadata, steps) of an agent trajectory document and of the ones inside it, as ``parent.child``."""
    if not str(document.get("schema_version", "")).startswith("ATIF"):
        raise Violation(f"schema version {document.get('schema_version')!r}")
    own = document.get("trajectory_id") or document.get("session_id") or ""
    own = f"{parent}.{own}" if parent else own
    steps: list[dict] = []
    sources = {"user": "user", "agent": "assistant", "system": "system"}
    for turn in document.get("steps") or []:
        if turn.get("source") not in sources:
            raise Violation(f"unknown source {turn.get('source')!r}")
        role = sources[turn["source"]]
        if turn.get("reasoning_content"):
            steps.append(_step(role, "thinking", turn["reasoning_content"], timestamp=turn.get("timestamp")))
        if turn.get("message"):
            steps.append(_step(role, "message", _flat(turn["message"]), timestamp=turn.get("timestamp")))
        names = {}
        for call in turn.get("tool_calls") or []:
            names[call.get("tool_call_id")] = call.get("function_name")
            steps.append(_step(role, "tool_call", name=call.get("function_name"), arguments=_json(call.get("arguments")), timestamp=turn.get("timestamp")))
        for result in (turn.get("observation") or {}).get("results") or []:
            source = result.get("source_call_id")
            if source is not None and source not in names:
                raise Violation(f"a result of unknown call {source!r}")
            steps.append(_step("tool", "tool_result", _flat(result.get("content")), name=names.get(source), timestamp=turn.get("timestamp")))
    yield own, {"agent": (document.get("agent") or {}).get("name")}, steps
    for inner in document.get("subagent_trajectories") or []:
        yield from atif_documents(inner, own)


def _parsed(df: DataFrame, dataset: str, parse: Callable[[str, str], Iterator[tuple[str, dict, list[dict]]]]) -> DataFrame:
    """``df`` has file and value; parse(value, file) yields (id, metadata, steps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for own, metadata, steps in parse(value, file):
                        base = {"dataset": dataset, "id": safe_id(own), "metadata": json.dumps(metadata, sort_keys=True, ensure_ascii=False)}
                        rows += [base | {"step": i, "violation": None} | s for i, s in enumerate(steps)]
                except (ValueError, KeyError, TypeError, AttributeError, SyntaxError) as e:
                    rows.append({"dataset": dataset, "violation": f"{file}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in PARSED], schema=PARSED)

    return df.mapInArrow(run, PARSED_DDL)


def _texts(spark: SparkSession, paths: list[str], whole: bool) -> DataFrame:
    return spark.read.text(paths, wholetext=whole).select(F.input_file_name().alias("file"), "value")


def _scalars(record: dict, keys: tuple[str, ...]) -> dict:
    return {k: record[k] for k in keys or record if k in record and isinstance(record[k], (str, int, float, bool))}


def safe_ids(text: Column) -> Column:
    """F1 of a column."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), 1, 120)


def messages_of(texts: DataFrame, dataset: str, options: Messages | None = None, several: bool = False) -> DataFrame:
    """``texts`` (file, value) hold a JSON record each, or with ``several`` one record or a list of them."""
    options = options or Messages()

    def one(record: dict, fallback: str) -> tuple[str, dict, list[dict]]:
        return str(record[options.id_key] if options.id_key else record.get("id", fallback)), _scalars(record, options.metadata_keys), options.steps(record)

    def parse(value: str, file: str) -> Iterator[tuple[str, dict, list[dict]]]:
        if not value.strip():
            return
        found = json.loads(value)
        if several:
            records = found if isinstance(found, list) else [found]
            yield from (one(record, f"{file.rsplit('/', 1)[-1]}-{i}") for i, record in enumerate(records))
        else:
            yield one(found, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16])

    return _parsed(texts, dataset, parse)


def read_messages(spark: SparkSession, paths: list[str], dataset: str, options: Messages | None = None) -> DataFrame:
    """``.jsonl`` a record a line, ``.json`` one record or a list of them."""
    lines, documents = [p for p in paths if not p.endswith(".json")], [p for p in paths if p.endswith(".json")]
    parts = ([messages_of(_texts(spark, lines, False), dataset, options)] if lines else []) + ([messages_of(_texts(spark, documents, True), dataset, options, several=True)] if documents else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_sessions(spark: SparkSession, paths: list[str], dataset: str, options: Session | None = None) -> DataFrame:
    """A file is a session; its name is the id."""
    return sessions_of(_texts(spark, paths, True), dataset, options)


def sessions_of(texts: DataFrame, dataset: str, options: Session | None = None) -> DataFrame:
    """``texts`` (file, value) hold the lines of a session each."""
    options = options or Session()

    def session(value: str, file: str) -> Iterator[tuple[str, dict, list[dict]]]:
        lines = [json.loads(x) for x in value.splitlines() if x.strip()]
        steps = options.steps(lines)
        if steps:
            first = next((x for x in lines if x.get("cwd")), {})
            yield file.rsplit("/", 1)[-1].removesuffix(".jsonl"), _scalars(first, ("cwd", "gitBranch", "version")), steps

    return _parsed(texts, dataset, session)


def read_atif(spark: SparkSession, paths: list[str], dataset: str) -> DataFrame:
    """Documents; the same identity read twice must be the same document (see ``checked``)."""
    return atif_of(_texts(spark, paths, True), dataset)


def atif_of(texts: DataFrame, dataset: str) -> DataFrame:
    """``texts`` (file, value) hold a document each."""
    return _parsed(texts, dataset, lambda value, file: atif_documents(json.loads(value)))


def checked(parsed: DataFrame) -> DataFrame:
    """Steps with key = dataset/id, after all records were found sound and no id came twice with different steps."""
    bad = [r["violation"] for r in parsed.filter("violation IS NOT NULL").select("violation").limit(5).collect()]
    if bad:
        raise Violation("; ".join(bad))
    steps = parsed.drop("violation").withColumn("key", F.concat_ws("/", "dataset", "id"))
    twice = [r["key"] for r in steps.groupBy("key", "step").agg(F.count_distinct(F.struct("role", "kind", "content")).alias("n"), F.count("*").alias("m")).filter("n > 1").select("key").distinct().limit(5).collect()]
    if twice:
        raise Violation(f"ids that come twice: {twice}")
    return steps.dropDuplicates(["key", "step"])


def missing_calls(recorded: DataFrame, steps: DataFrame) -> DataFrame:
    """Recorded (key, tool) calls that no parsed step accounts for, with multiplicity."""
    return recorded.select("key", "tool").exceptAll(steps.filter("kind = 'tool_call'").select("key", F.col("name").alias("tool")))


#: Readers by name; projects add their own.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"messages": read_messages, "sessions": read_sessions, "atif": read_atif}


def adapter(name: str, own: dict[str, Callable[..., DataFrame]] | None = None) -> Callable[..., DataFrame]:
    """A project's reader of that name, a library's, or what ``module:function`` names."""
    known = ADAPTERS | (own or {})
    if name in known:
        return known[name]
    module, _, function = name.partition(":")
    if not function:
        raise Violation(f"no adapter {name!r}; there are {sorted(known)}")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise Violation(f"adapter {name!r}: {e}") from e


def path_metadata(file: Column, pattern: str) -> Column:
    """The named groups of a pattern over a file's path, as JSON; null where it doesn't match."""
    names = list(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    if len(names) != re.compile(pattern).groups:
        raise Violation("every group of a path pattern has a name")
    return F.when(file.rlike(plain), F.to_json(F.struct(*[F.regexp_extract(file, plain, i).alias(n) for i, n in enumerate(names, 1)])))


def index_of(steps: DataFrame, datasets: list[str]) -> DataFrame:
    """Key, dataset, place, n_steps, chars, digest of a trajectory's text; datasets in the order they are configured in."""
    place = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "role", "content"))), lambda s: F.concat_ws("\n", s["role"], s["content"])), "\n\n")
    return steps.filter(F.col("dataset").isin(*datasets)).groupBy("key", "dataset").agg(F.count("*").alias("n_steps"), F.sum(F.length("content")).alias("chars"), F.sha2(text, 256).alias("digest")).withColumn("place", place)


def roles_seen(records: list[dict], key: str = "role") -> Counter:
    return Counter(m.get(key) for r in records for m in r.get("messages", []))
