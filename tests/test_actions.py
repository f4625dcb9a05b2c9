import json

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from trailmark.functions import objects as O
from trailmark.operators import actions as A
from trailmark.operators import features as X
from trailmark.operators import relations as R
from trailmark.operators import specs as P
from trailmark.operators import turns as T
from trailmark.sources import config

STEPS = "key string, step long, role string, kind string, name string, content string, arguments string, is_error boolean, timestamp timestamp"


def steps(spark):
    call = lambda i, tool, args: ("k", i, "assistant", "tool_call", tool, "", json.dumps(args), None, None)
    result = lambda i, tool, text, bad=None: ("k", i, "tool", "tool_result", tool, text, None, bad, None)
    rows = [
        ("k", 0, "user", "message", None, "fix it", None, None, None),
        call(1, "Read", {"file_path": "/p/a.py"}), result(2, "Read", "text"),
        call(3, "Edit", {"file_path": "/p/a.py", "new_string": "x"}), result(4, "Edit", "String to replace not found"),
        call(5, "Edit", {"file_path": "/p/a.py", "new_string": "x"}), result(6, None, "done"),
        call(7, "Bash", {"command": "cd /p && pytest -q tests/test_a.py"}), result(8, "Bash", "Exit code 1\nfailed"),
        call(9, "Bash", {"command": "git push --force"}),
        ("k", 10, "user", "notice", "interruption", "[Request interrupted by user]", None, None, None),
    ]
    return spark.createDataFrame(rows, STEPS)


def test_actions(spark):
    made = A.actions(steps(spark))
    got = [tuple(r) for r in made.orderBy("position").select("call", "ordinal", "act", "program", "effect", "outcome", "error").collect()]
    assert got == [
        (1, 0, "read", None, "none", "ok", None),
        (3, 0, "edit", None, "workspace", "error", "mismatch"),
        (5, 0, "edit", None, "workspace", "ok", None),
        (7, 0, "shell", "cd", "none", "error", "exit"),
        (7, 1, "test", "pytest", "none", "error", "test_failed"),
        (9, 0, "vcs", "git", "destructive", "unanswered", None),
    ]
    kinds = {(r["kind"], r["later"], r["earlier"]) for r in R.relations(made).collect()}
    assert {("seen", 1, 0), ("seen", 2, 0), ("reedit", 2, 1), ("retry", 2, 1), ("verify", 4, 2)} <= kinds
    turn = T.turn_summary(steps(spark), made).collect()[0]
    assert (turn["ended_by"], turn["calls"], turn["actions"], turn["edits"], turn["verifications"], turn["failed_calls"], turn["last_program"]) == ("interrupt", 5, 6, 2, 1, 2, "git")
    f = X.action_features(made, R.relations(made)).collect()[0]
    assert f["edit_verified_share"] == 0.5 and f["verified_at_end"] and f["side_effects"] == 1


@pytest.mark.parametrize(
    ("text", "act", "flag", "want"),
    [
        (None, "run", None, ("unanswered", None)),
        ("", "run", None, ("empty", None)),
        ("fine", "run", None, ("ok", None)),
        ("fine", "run", True, ("error", "unknown")),
        ("Exit code 127", "run", None, ("error", "tool_missing")),
        ("exited with code 124", "test", None, ("error", "timeout")),
        ("Error: permission denied", "read", None, ("error", "permission")),
        ("Traceback (most recent call last):", "run", None, ("error", "exception")),
        ("a.py does not exist", "read", None, ("error", "not_found")),
        ("The user doesn't want to proceed", "edit", None, ("rejected", "denied")),
    ],
)
def test_outcome(spark, text, act, flag, want):
    df = spark.createDataFrame([(text, act, flag)], "t string, a string, f boolean")
    r = df.select(O.outcome(F.col("t"), F.col("a"), F.col("f")).alias("o")).first()["o"]
    assert (r["outcome"], r["error"]) == want


def test_objects(spark):
    rows = [("tests/test_x.py", "/p"), ("~/y", "/p"), ("../poetry.lock", "/p/q"), ("src/*.ts", None), ("docs/a.md", "/"), ("conf.yaml", "/p"), ("x.py", "/p")]
    df = spark.createDataFrame(rows, "path string, root string")
    got = df.select("path", O.resolved("path", "root").alias("r"), O.object_kind(F.col("path")).alias("k"), O.file_role(F.col("path")).alias("o")).collect()
    assert [(r["r"], r["k"], r["o"]) for r in got] == [("/p/tests/test_x.py", "file", "test"), ("~/y", "file", "other"), ("/p/poetry.lock", "file", "lock"), ("src/*.ts", "glob", "source"), ("/docs/a.md", "file", "docs"), ("/p/conf.yaml", "file", "config"), ("/p/x.py", "file", "source")]
    roots = spark.createDataFrame([(["/a/b/c.py", "/a/b/d/e.py"],), (["/home/u/x", "/home/u/y"],), ([],), (["/a/b/c", "/z/y"],)], "p array<string>")
    assert [r["r"] for r in roots.select(O.common_root(F.col("p")).alias("r")).collect()] == ["/a/b", None, None, None]


def test_specs(spark):
    for bad in ({"name": "A", "kind": "scalar"}, {"name": "a__b", "kind": "scalar"}, {"name": "a", "kind": "scalar", "labels": ["x"]}, {"name": "a", "kind": "scalar", "range": (2, 1)}, {"name": "a", "kind": "event"}, {"name": "a", "kind": "odd"}, {"name": "a", "kind": "scalar", "more": 1}):
        with pytest.raises(ValidationError):
            P.Spec(**bad)
    specs = [P.Spec(name="s", kind="scalar", range=(0, 1)), P.Spec(name="c", kind="category", labels=["x", "y"]), P.Spec(name="l", kind="set")]
    ok = spark.createDataFrame([("k", 0.5, "x", ["a"]), ("m", None, None, None)], "key string, s double, c string, l array<string>")
    assert P.validated(ok, specs).count() == 2
    for column, value in (("s", 2.0), ("s", float("nan")), ("c", "z"), ("l", ["a", "a"])):
        with pytest.raises(ValueError, match=column):
            P.validated(ok.withColumn(column, F.lit(value)), specs)
    assert P.conformed(ok.withColumn("s", F.lit("text")).drop("l"), specs).first().asDict() == {"key": "k", "s": None, "c": "x", "l": None}


def test_answers(spark):
    units = spark.createDataFrame([("k", 0, 0, 1, "a"), ("k", 1, 2, 3, "b"), ("m", 0, 0, 0, "c")], "key string, index long, start long, end long, text string")
    specs = [P.Spec(name="mood", kind="category", labels=["good", "bad"])]
    asked = P.requests(units, "how?", specs)
    ids = {r["text"]: r["request"] for r in asked.collect()}
    answers = spark.createDataFrame([(ids["a"], "ok", '{"mood": "good"}'), (ids["c"], "refused", None)], "request string, status string, answer string")
    got, pending = P.answered(asked, answers, specs)
    assert sorted((r["key"], r["value"], r["status"]) for r in got.collect()) == [("k", "good", "ok"), ("m", None, "refused")]
    assert [r["text"] for r in pending.collect()] == ["b"]
    assert {r["key"] for r in P.wrong_lengths(got, units).collect()} == {"k", "m"}


def test_config(tmp_path):
    (tmp_path / "p.yaml").write_text(config.TEMPLATE)
    assert config.load(str(tmp_path / "p.yaml")).datasets[0].name == "example"
    (tmp_path / "p.yaml").write_text("odd: 1")
    with pytest.raises(ValidationError):
        config.load(str(tmp_path / "p.yaml"))
