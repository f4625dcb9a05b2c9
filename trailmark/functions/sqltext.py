"""SQL texts as facts: tables, atoms, compared values, templates (T7 to T14), and the bridge from one dialect.

Catalyst's own parser gives the tree; it runs on the driver, so texts are parsed once each.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SqlError(ValueError):
    pass


@dataclass
class Facts:
    tables: set[str] = field(default_factory=set)
    atoms: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)
    nodes: list[str] = field(default_factory=list)


def _plan(spark: SparkSession, text: str) -> list:
    """The parsed plan as nested (class, node, children)."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        listed = json.loads(parser.parsePlan(text).toJSON())
    except Exception as e:  # py4j wraps the parser's error
        raise SqlError(str(e).splitlines()[0]) from e
    return _nest(iter(listed))


def _nest(nodes) -> tuple:
    node = next(nodes)
    return node["class"].rsplit(".", 1)[-1].rstrip("$"), node, [_nest(nodes) for _ in range(node["num-children"])]


def _expressions(value) -> list[tuple]:
    """Expression trees held by a field of a plan node: lists of nodes in the order of a walk."""
    if isinstance(value, list) and value and isinstance(value[0], dict) and "class" in value[0]:
        return [_nest(iter(value))]
    if isinstance(value, list):
        return [x for v in value for x in _expressions(v)]
    return []


def _columns(tree: tuple) -> list[str]:
    name, node, children = tree
    own = [_name(node["nameParts"])] if name == "UnresolvedAttribute" else []
    return own + [c for child in children for c in _columns(child)] + [c for k, v in node.items() if k not in ("class", "num-children", "nameParts") for t in _expressions(v) for c in _columns(t)]


def _name(parts) -> str:
    return (parts if isinstance(parts, list) else re.findall(r"[^\[\], ]+", parts))[-1]


def _functions(tree: tuple) -> list[tuple[str, list[str]]]:
    name, node, children = tree
    own = [(_name(node["nameParts"]).lower(), _columns(tree))] if name == "UnresolvedFunction" else []
    held = [t for k, v in node.items() if k not in ("class", "nameParts") for t in _expressions(v)]
    return own + [f for child in (*children, *held) for f in _functions(child)]


# Aggregates that are told apart by role.
AGGREGATES = {"count", "sum", "avg", "mean", "min", "max", "median", "mode", "stddev", "variance", "quantile_cont", "percentile", "percentile_approx", "approx_quantile"}
_COMPARISONS = {"EqualTo": "=", "LessThan": "<", "GreaterThan": ">", "LessThanOrEqual": "<=", "GreaterThanOrEqual": ">=", "In": "=", "Like": "like"}


def facts(spark: SparkSession, text: str) -> Facts:
    """Tables read, ``role:column`` atoms and ``column=literal`` values of one query."""
    out, ctes = Facts(), set()

    def compare(tree: tuple) -> None:
        name, node, children = tree
        if name in _COMPARISONS:
            columns, literals = [c for x in children for c in _columns(x)], [x[1].get("value") for x in children if x[0] == "Literal"]
            out.values.update(f"{c}{_COMPARISONS[name]}{v}" for c in columns[:1] for v in literals if v is not None)
        for child in (*children, *[t for k, v in node.items() if k != "class" for t in _expressions(v)]):
            compare(child)

    def walk(tree: tuple) -> None:
        name, node, children = tree
        out.nodes.append(name)
        held = {k: _expressions(v) for k, v in node.items() if k not in ("class", "num-children")}
        if name == "UnresolvedRelation":
            out.tables.add(_name(node["multipartIdentifier"]))
        elif name in ("Filter", "UnresolvedHaving"):
            for t in (x for v in held.values() for x in v):
                if t[0].endswith(("Filter", "Relation", "Project")):
                    continue
                out.atoms.update(f"filter:{c}" for c in _columns(t))
                compare(t)
        elif name in ("Project", "Aggregate"):
            for t in held.get("groupingExpressions", []):
                out.atoms.update(f"group:{c}" for c in _columns(t))
            for t in held.get("projectList", []) + held.get("aggregateExpressions", []):
                called = [f for f in _functions(t) if f[0] in AGGREGATES]
                out.atoms.update(f"{f}:{c}" for f, cs in called for c in cs or ["*"])
                inside = {c for _, cs in called for c in cs}
                out.atoms.update(f"show:{c}" for c in _columns(t) if c not in inside)
        elif name == "Sort":
            out.atoms.update(f"order:{c}" for v in held.values() for t in v for c in _columns(t))
        elif name == "Join":
            out.atoms.update(f"join:{c}" for t in held.get("condition", []) for c in _columns(t))
        elif name in ("UnresolvedWith", "CTE"):
            ctes.update(re.findall(r"(?i)(?:with|,)\s+(\w+)\s+as\s*\(", text))
            for v in held.values():
                for t in v:
                    walk(t)
        for child in children:
            walk(child)

    walk(_plan(spark, text))
    ctes.update(x for x in re.findall(r"(?i)\b(?:with|,)\s*(\w+)\s+as\s*\(", text))
    out.tables |= {t for t in re.findall(r"(?i)\b(?:from|join)\s+`?(\w+)`?", text)}
    out.tables -= ctes
    return out


_LITERAL = re.compile(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b")


def template(text: str) -> str:
    """Literals as ``?``, white space as one blank, names in lower case."""
    return re.sub(r"\s+", " ", _LITERAL.sub("?", text)).strip().rstrip(";").lower()


def templates(text: Column) -> Column:
    """T12 of a column."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, _LITERAL.pattern, "?"), r"\s+", " "))
    return F.lower(F.regexp_replace(plain, ";+$", ""))


def canonical_forms(column: str) -> Column:
    """T13 of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical(t))

    return run(column)


def canonical(text: str) -> str:
    """A template in which order that does not matter is sorted: select list, AND and OR operands, IN lists, group keys."""
    made = re.sub(r"\s*(<>|!=|<=|>=|=|<|>|,)\s*", lambda m: ", " if m[1] == "," else f" {m[1]} ", template(text))
    made = re.sub(r"\bin \((\?(?:, ?\?)*)\)", "in (?)", made)

    def ordered(pattern: str, by: str, s: str) -> str:
        return re.sub(pattern, lambda m: m[1] + f"{by} ".join(sorted(x.strip() for x in m[2].split(by))) + m[3], s)

    made = ordered(r"(select )([^()]*?)( from )", ",", made)
    made = ordered(r"(group by )([^()]*?)( having | order | limit |\)|$)", ",", made)
    return re.sub(r"(where )(.*?)( group | order | limit | having |$)", lambda m: m[1] + " and ".join(sorted(re.split(r"\s+and\s+", m[2]))) + m[3] if " or " not in m[2] and "(" not in m[2] and "between" not in m[2] else m[0], made)


def guard(spark: SparkSession, text: str, allowed: set[str] | None = None) -> None:
    """One SELECT, over allowed tables only."""
    if ";" in text.strip().rstrip(";"):
        raise SqlError("one statement only")
    if not re.match(r"(?is)\s*(select|with|values|\(|from)\b", text):
        raise SqlError("only queries are allowed")
    found = facts(spark, text).tables
    if allowed is not None and found - allowed:
        raise SqlError(f"tables that may not be read: {sorted(found - allowed)}")


_REWRITES = (
    (r"(?i)'([\w./-]+?)\.parquet'", lambda m: "`" + m[1].rsplit("/", 1)[-1] + "`"),
    (r"(?i)\bquantile_cont\s*\(", "percentile("),
    (r"(?i)\bregexp_matches\s*\(", "regexp_like("),
    (r"(?i)\blist_contains\s*\(", "array_contains("),
    (r"(?i)\barray_to_string\s*\(", "array_join("),
    (r"(?i)\bjson_keys\s*\(", "json_object_keys("),
    (r"(?i)\bjson_valid\s*\(([^()]*)\)", r"(try_parse_json(\1) IS NOT NULL)"),
    (r"(?i)\bunnest\s*\(", "explode("),
    (r"(?i)\bfilter\s*\(\s*(?!where\b)(?=[^,()]*[=<>])", "FILTER (WHERE "),
)


def bridged(text: str) -> str:
    """S12, Q: the dialect that analysts write, in Spark's: file names as views, function names, FILTER, QUALIFY."""
    for pattern, to in _REWRITES:
        text = re.sub(pattern, to, text)
    m = re.search(r"(?is)^\s*select\s+(.*?)\s+from\s+(.*?)\s+qualify\s+(.*)$", text)
    if m:
        condition, depth, end = m[3], 0, len(m[3])
        for i, c in enumerate(condition):
            depth += (c == "(") - (c == ")")
            if not depth and re.match(r"(?i)\s(order\s+by|limit)\b", condition[i:]):
                end = i
                break
        text = f"SELECT * EXCEPT (__q) FROM (SELECT {m[1]}, {condition[:end]} AS __q FROM {m[2]}) WHERE __q{condition[end:]}"
    return text


def run_query(spark: SparkSession, text: str, views: dict[str, DataFrame], limit: int = 200, only_given: bool = True) -> DataFrame:
    """A query over views, guarded, at most ``limit`` rows (the command's own limit)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    made = bridged(text.strip().rstrip(";"))
    guard(spark, made, set(views) if only_given else None)
    return spark.sql(made).limit(limit)
