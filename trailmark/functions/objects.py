"""Paths, their kinds and roles, and the outcome of a call as column expressions."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPENING, SHORT_ERROR, SHORT_MISSING = 400, 300, 600

# Exit codes with a meaning of their own.
EXIT_KINDS = {124: "timeout", 143: "timeout", 137: "timeout", 127: "tool_missing", 126: "permission"}
# Marks in the opening of a result, in the order they are looked for.
REJECTED = ("the user doesn't want to proceed", "user rejected")
INTERRUPTED = ("[request interrupted by user", "interrupted by user")
DENIED = ("permission denied by policy", "denied by the user", "not allowed")
SIBLING = ("sibling tool call errored",)
ERROR_MARKS = (
    ("timeout", ("timed out", "timeout")),
    ("permission", ("permission denied", "eacces")),
    ("not_found", ("no such file or directory", "not found", "does not exist", "enoent")),
    ("mismatch", ("string to replace not found", "old_string", "no match")),
    ("precondition", ("has not been read", "must read", "modified since")),
    ("argument", ("invalid argument", "inputvalidationerror", "missing required")),
    ("tool_missing", ("command not found",)),
    ("exception", ("traceback (most recent call last)", "exception:")),
)


def resolved(path: str, root: str) -> Column:
    """joined to a root and normalised; ``~`` paths stay."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([p if p is None or p.startswith("~") else posixpath.normpath(posixpath.join(r or "", p)) for p, r in zip(paths, roots, strict=True)])

    return run(path, root)


def object_kind(path: Column) -> Column:
    """F7."""
    return F.when(path.rlike(r"[*?{}]"), "glob").when(path.rlike(r"/$|^\.{1,2}$"), "directory").otherwise("file")


def file_role(path: Column) -> Column:
    """F8: the first rule that holds."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    parents = F.lower(path)
    inside = lambda *names: parents.rlike("(^|/)(" + "|".join(names) + ")/")
    return (
        F.when(name.rlike(r"^(test_.*|.*_test|.*\.test|.*\.spec|conftest)\.[a-z]+$") | inside("tests?", "__tests__", "spec"), "test")
        .when(name.isin("package-lock.json", "yarn.lock", "poetry.lock", "cargo.lock", "uv.lock", "go.sum"), "lock")
        .when(inside("node_modules", "vendor", r"\.venv", "site-packages"), "vendored")
        .when(inside("build", "dist", "target", "out"), "built")
        .when(inside(r"\.github", r"\.gitlab", r"\.circleci"), "ci")
        .when(name.isin("dockerfile", "makefile", "jenkinsfile") | name.rlike(r"^docker-compose.*\.ya?ml$"), "build")
        .when(name.rlike(r"\.(toml|ya?ml|ini|cfg|json|env|properties)$"), "config")
        .when(name.rlike(r"\.(md|rst|txt|adoc)$") | inside("docs?"), "docs")
        .when(name.rlike(r"\.(csv|tsv|parquet|sqlite|db|jsonl)$") | inside("data", "fixtures"), "data")
        .when(name.rlike(r"\.(png|jpe?g|gif|svg|pdf|mp4)$"), "media")
        .when(name.rlike(r"\.(py|js|ts|tsx|jsx|go|rs|c|h|cc|cpp|hpp|java|kt|rb|php|scala|sh|sql|css|html)$"), "source")
        .otherwise("other")
    )


def common_root(paths: Column) -> Column:
    """the longest common directory of an array of paths, null for none, ``/`` and home directories."""
    parts = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1))
    shared = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.try_element_at(parts, F.lit(1)),
        lambda a, b: F.slice(a, 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))),
    )
    root = F.array_join(shared, "/")
    return F.when((F.size(paths) > 0) & ~root.isin("", "/", "/root") & ~root.rlike(r"^/(home|Users)(/[^/]*)?$"), root)


def first_string(arguments: Column, keys: list[str]) -> Column:
    """the first of some keys that is a string of a JSON object."""
    value = F.try_parse_json(arguments)
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string")) for k in keys])


def new_lines(text: Column) -> Column:
    """F11."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def outcome(result: Column, act: Column, flagged: Column) -> Column:
    """struct<outcome, error> of a call's result text; a missing result is unanswered.

    Looked for in order: rejection, interruption, denial, a failed sibling, a non-zero exit code, a failing opening,
    an edit without a match, an exception of a run, test or build, the source's own flag, emptiness, a short "not found".
    """
    opening = F.lower(F.substring(result, 1, OPENING))
    code = F.try_to_number(F.nullif(F.regexp_extract(opening, r"exit(?:ed with)?(?: code| status)?:? (\d{1,3})", 1), F.lit("")), F.lit("999")).cast("int")
    made = lambda o, e=None: F.struct(F.lit(o).alias("outcome"), (e if isinstance(e, Column) else F.lit(e).cast("string")).alias("error"))
    by_code = F.lit(None).cast("string")
    for c, kind in EXIT_KINDS.items():
        by_code = F.coalesce(F.when(code == c, kind), by_code)
    by_code = F.coalesce(by_code, F.when(act == "test", "test_failed").when(act == "build", "build_failed").otherwise("exit"))
    kind = F.lit(None).cast("string")
    for name, marks in reversed(ERROR_MARKS):
        kind = F.when(_holds(opening, marks), name).otherwise(kind)
    starts_bad = opening.rlike(r"^\s*(<tool_use_error>|error[: ]|fatal: )")
    return (
        F.when(result.isNull(), made("unanswered"))
        .when(_holds(opening, REJECTED), made("rejected", "denied"))
        .when(_holds(opening, INTERRUPTED), made("interrupted"))
        .when(_holds(opening, DENIED), made("rejected", "denied"))
        .when(_holds(opening, SIBLING), made("error", "sibling"))
        .when(F.coalesce(code != 0, F.lit(False)), made("error", by_code))
        .when(starts_bad, made("error", F.coalesce(kind, F.lit("unknown"))))
        .when((act == "edit") & _holds(opening, ERROR_MARKS[3][1]) & (F.length(result) < SHORT_ERROR), made("error", "mismatch"))
        .when(act.isin("run", "test", "build") & _holds(opening, ERROR_MARKS[7][1]), made("error", "exception"))
        .when(F.coalesce(flagged, F.lit(False)), made("error", F.coalesce(kind, F.lit("unknown"))))
        .when(F.trim(result) == "", made("empty"))
        .when(_holds(opening, ERROR_MARKS[2][1]) & (F.length(result) < SHORT_MISSING) & act.isin("read", "search", "inspect"), made("error", "not_found"))
        .otherwise(made("ok"))
    )
