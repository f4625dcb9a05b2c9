import json

import pytest

from trailmark.functions import shell, sqltext
from trailmark.sources import adapters as A


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cd lib && ruff check . | head -3", [("cd", None, "shell", "none", "first"), ("ruff", None, "build", "none", "and"), ("head", None, "inspect", "none", "pipe")]),
        ("git push -f up b; git push up b", [("git", "push", "vcs", "destructive", "first"), ("git", "push", "vcs", "remote", "seq")]),
        ("git checkout -q . && git checkout topic", [("git", "checkout", "vcs", "destructive", "first"), ("git", "checkout", "vcs", "workspace", "and")]),
        ("sudo -u root apt-get install -y x", [("apt-get", None, "install", "environment", "first")]),
        ("nice -n 3 poetry run tox -e py", [("tox", None, "test", "none", "first")]),
        ("printf a > out.txt", [("printf", None, "inspect", "workspace", "first")]),
        ("printf a > /dev/null", [("printf", None, "inspect", "none", "first")]),
        ("sh -c 'rmdir /tmp/x'", [("sh", None, "run", "unknown", "first"), ("rmdir", None, "edit", "destructive", "first")]),
        ("cat <<EOF\nrm x\nEOF\nls", [("cat", None, "inspect", "none", "first"), ("ls", None, "inspect", "none", "seq")]),
        ("python -m unittest -v", [("python", "unittest", "test", "none", "first")]),
        ("yarn run lint; bun add left; go vet ./...", [("yarn", "run lint", "build", "none", "first"), ("bun", "add", "install", "environment", "seq"), ("go", "vet", "build", "workspace", "seq")]),
        ("gh issue list; gh issue close 4; gh api -f a=b repos", [("gh", "issue list", "network", "none", "first"), ("gh", "issue close", "network", "remote", "seq"), ("gh", "api", "network", "remote", "seq")]),
        ("curl -d a=b u; curl u", [("curl", None, "network", "remote", "first"), ("curl", None, "network", "none", "seq")]),
        ("frobnicate -x", [("frobnicate", None, "other", "unknown", "first")]),
    ],
)
def test_shell(text, want):
    assert [(c.program, c.subcommand, c.act, c.effect, c.join) for c in shell.parse(text)] == want


def test_shell_nesting_and_force():
    found = shell.parse("if [ -e a ]; then for f in *; do rm -f $f; done; else echo $(git status); fi")
    assert [(c.program, c.nesting) for c in found] == [("[", ("if",)), ("rm", ("if", "loop")), ("echo", ("if",)), ("git", ("if", "substitution"))]
    assert found[1].forced and not found[0].forced


def test_shell_descriptions():
    (found,) = shell.parse("sudo env A=1 sed -n -e s/a/b/ one.txt > two.txt")
    assert (found.wrappers, found.flags, found.operands, found.paths, found.known) == (["sudo", "env"], ["-n", "-e"], ["s/a/b/", "one.txt"], ["one.txt", "two.txt"], True)
    (found,) = shell.parse("git -C sub reset --hard -q v1 ./x.py")
    assert (found.options, found.forced, found.effect, found.paths) == ({"-C": "sub"}, True, "destructive", ["./x.py"])
    (found,) = shell.parse("cp -rf a b")
    assert found.forced and found.paths == ["a", "b"]
    shell.know("build none -: frobcheck", "frobcheck: test none: unit", "forced frobcheck unit: --now")
    (found,) = shell.parse("frobcheck unit --now")
    assert (found.subcommand, found.act, found.forced) == ("unit", "test", True)


@pytest.mark.parametrize("text", ["echo 'open", "echo $(ls", "if true; then ls", "fi", "ls )"])
def test_shell_errors(text):
    with pytest.raises(shell.ShellError):
        shell.parse(text)
    assert shell.commands_of(text)[0]["act"] == "shell"


def test_shell_looks_programs_up(monkeypatch):
    """A command is looked up, not held against every known program; a backslash at the end is an open quote."""

    class Known(dict):
        def __iter__(self):
            raise AssertionError("goes through all programs")

    monkeypatch.setattr(shell, "_KNOWN", Known(shell._KNOWN))
    assert [(c.program, c.subcommand) for c in shell.parse("gh pr view 3; npm run build; ls")] == [("gh", "pr view"), ("npm", "run build"), ("ls", None)]
    assert shell.commands_of('echo "a\\')[0]["act"] == "shell"


def test_effects_by_row(spark, tmp_path):
    """a script has its own row, also where two have the same key."""
    from trailmark.plans.catalogue_texts import t5_effects

    spark.sql("SELECT * FROM VALUES (3L, 1L), (3L, 2L), (4L, 1L), (8L, 1L) AS e(event_id, user_id)").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, t5_effects(spark, str(tmp_path)).collect())) == [(3, 4), (3, 4), (4, 1), (8, 5)]


def test_scripts_are_dealt(spark, tmp_path):
    """rows of one file go to several tasks, a text that all of them have too, equal texts side by side."""
    from trailmark.plans.catalogue_texts import scripts

    spark.range(7000).selectExpr("id * 7 AS event_id", "id DIV 3500 AS user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = scripts(spark, str(tmp_path)).rdd.map(lambda r: r["text"]).glom().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(map(len, parts)) == 7000 and min(map(len, parts)) > 0 and len(parts) == 4
    assert all(p == sorted(p) for p in parts)


def test_sql_facts(spark):
    f = sqltext.facts(spark, "WITH c AS (SELECT * FROM u) SELECT a, sum(b) FROM t JOIN c ON t.k = c.k WHERE x = 'q' AND y > 3 GROUP BY a ORDER BY a")
    assert f.tables == {"t", "u"}
    assert {"filter:x", "filter:y", "group:a", "order:a", "sum:b", "show:a", "join:k"} <= f.atoms
    assert "x=q" in f.values
    assert sqltext.canonical("SELECT a, b FROM t WHERE x = 1 AND y = 'z' GROUP BY a, b") == sqltext.canonical("select b,a from t where y='q'   and x = 2 group by b, a;".replace("y='q'", "y = 'q'"))


def test_sql_guard(spark):
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "SELECT * FROM secret", "SELEC 1"):
        with pytest.raises(sqltext.SqlError):
            sqltext.guard(spark, bad, {"t"})
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 8.0)], "k int, v double")
    got = sqltext.run_query(spark, "SELECT k, count(*) FILTER (v > 3) AS n, quantile_cont(v, 0.5) AS m FROM 't.parquet' GROUP BY ALL", {"t": df})
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3.0), (2, 1, 8.0)]
    last = sqltext.run_query(spark, "SELECT k, v FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1", {"t": df})
    assert sorted(map(tuple, last.collect())) == [(1, 4.0), (2, 8.0)]


def test_messages(spark, tmp_path):
    records = [
        {"id": "a b", "messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image_url"}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": {"q": 1}}}]}, {"role": "tool", "tool_call_id": "1", "name": "?", "content": "ok"}]},
        {"id": "c", "messages": [{"role": "human", "content": "hi"}, {"role": "gpt", "content": "ho", "reasoning_content": "hm"}]},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, records)))
    steps = A.checked(A.read_messages(spark, [str(tmp_path / "m.jsonl")], "d")).orderBy("key", "step").collect()
    assert [(r["key"], r["kind"], r["name"], r["content"]) for r in steps] == [("d/a_b", "message", None, "x\n[image]"), ("d/a_b", "tool_call", "f", ""), ("d/a_b", "tool_result", "f", "ok"), ("d/c", "message", None, "hi"), ("d/c", "thinking", None, "hm"), ("d/c", "message", None, "ho")]


@pytest.mark.parametrize("record", [{"id": "1", "messages": [{"role": "alien", "content": "x"}]}, {"id": "1", "messages": [{"role": "user", "content": "x", "odd": 1}]}, {"id": "1", "messages": []}])
def test_messages_refused(spark, tmp_path, record):
    (tmp_path / "m.jsonl").write_text(json.dumps(record))
    with pytest.raises(A.Violation):
        A.checked(A.read_messages(spark, [str(tmp_path / "m.jsonl")], "d"))


def test_sessions_and_atif(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "go"}, "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "f", "is_error": False}]}},
        {"type": "user", "message": {"role": "user", "content": "[Request interrupted by user]"}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = A.checked(A.read_sessions(spark, [str(tmp_path / "s1.jsonl")], "d")).orderBy("step").collect()
    assert [(r["kind"], r["name"]) for r in got] == [("message", None), ("tool_call", "Bash"), ("tool_result", "Bash"), ("notice", "interruption")]
    document = {"schema_version": "ATIF-v1", "session_id": "p", "steps": [{"source": "user", "message": "x"}], "subagent_trajectories": [{"schema_version": "ATIF-v1", "trajectory_id": "q", "steps": [{"source": "agent", "message": "y"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(document))
    assert {r["key"] for r in A.checked(A.read_atif(spark, [str(tmp_path / "t.json")], "d")).collect()} == {"d/p", "d/p.q"}
    calls = spark.createDataFrame([("d/s1", "Bash"), ("d/s1", "Bash")], "key string, tool string")
    assert A.missing_calls(calls, A.checked(A.read_sessions(spark, [str(tmp_path / "s1.jsonl")], "d"))).count() == 1
