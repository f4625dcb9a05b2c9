"""Window formulations against naive folds over one trajectory at a time."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trailmark.operators import events as E
from trailmark.operators import features as X
from trailmark.operators import relations as R
from trailmark.operators import steps as S

ACTION = st.tuples(
    st.sampled_from(["read", "edit", "test", "run", "ask", "vcs"]),
    st.lists(st.sampled_from(["a", "b", "d/x", "d"]), max_size=2, unique=True),
    st.sampled_from(["ok", "error"]),
    st.sampled_from(["t1", "t2"]),
    st.booleans(),
    st.sampled_from(["none", "destructive"]),
)
TRACES = st.lists(st.lists(ACTION, max_size=14), min_size=1, max_size=6)
SCHEMA = "key string, position long, call long, ordinal int, turn long, tool string, act string, program string, subcommand string, shape array<string>, effect string, outcome string, paths array<string>, text string"


def frame(spark, traces):
    rows, turn = [], 0
    for k, trace in enumerate(traces):
        turn = 0
        for i, (act, paths, outcome, text, new, effect) in enumerate(trace):
            turn += new
            rows.append((f"k{k}", i, 2 * i, 0, turn, "shell", act, "p", "reset" if act == "vcs" else None, ["range"] if new and act == "read" else None, effect, outcome, paths, text))
    return spark.createDataFrame(rows, SCHEMA), rows


def folded(rows):
    """Relations by walking each trajectory once."""
    by_key, out = defaultdict(list), []
    for r in rows:
        by_key[r[0]].append(r)
    for key, actions in by_key.items():
        same, seen, edited, whole, open_ = {}, {}, {}, {}, {}
        for n, (_, pos, _, _, turn, tool, act, program, sub, shape, effect, outcome, paths, text) in enumerate(actions):
            own = (act, program, sub, tuple(paths), text, tool)
            if act != "ask":
                if own in same:
                    out.append((key, "retry" if actions[same[own]][11] == "error" else "repeat", pos, same[own]))
                else:
                    for p in paths:
                        earlier = next((a for a in reversed(actions[:n]) if a[6] == act and p in a[12]), None)
                        if earlier and earlier[11] == "error":
                            out.append((key, "retry", pos, earlier[1]))
            same[own] = pos
            for p in paths:
                if act == "edit":
                    if p in seen:
                        out.append((key, "seen", pos, seen[p]))
                    if p in edited:
                        out.append((key, "reedit", pos, edited[p]))
                    edited[p], open_[p] = pos, (pos, turn)
                if act == "read":
                    if shape and p in whole:
                        out.append((key, "narrow", pos, whole[p]))
                    if not shape:
                        whole[p] = pos
                    seen[p] = pos
            if act == "test":
                for p, (at, t) in list(open_.items()):
                    if t == turn:
                        out.append((key, "verify", pos, at))
                        del open_[p]
            if act == "vcs" and effect == "destructive":
                for p, at in edited.items():
                    if not paths or p in paths or any(p.startswith(t.rstrip("/") + "/") for t in paths):
                        out.append((key, "undo", pos, at))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TRACES)
def test_relations(spark, traces):
    df, rows = frame(spark, traces)
    assert sorted(tuple(r) for r in R.relations(df).collect()) == folded(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TRACES)
def test_recovery_and_runs(spark, traces):
    df, rows = frame(spark, traces)
    want, runs = set(), set()
    by_key = defaultdict(list)
    for r in rows:
        by_key[r[0]].append(r)
    for key, actions in by_key.items():
        length = 0
        for i, a in enumerate(actions):
            later = next((b[1] for b in actions[i + 1 :] if b[6] == a[6] and b[11] == "ok" and (not a[12] or set(a[12]) & set(b[12]))), None)
            want.add((key, i, later))
            length = length + 1 if a[11] == "error" else 0
            if length == 3:
                runs.add((key, a[2], next((b[2] for b in actions[i + 1 :] if b[11] == "ok"), None)))
    got = E.recoveries(df, df.select("key", "position")).select("key", "position", "recovered_position")
    assert {tuple(r) for r in got.collect()} == want
    assert {(r["key"], r["step"], r["recovered_at"]) for r in E.failure_runs(df).collect()} == runs


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.booleans(), st.sampled_from("xy")), max_size=16), min_size=1, max_size=5))
def test_pairing(spark, traces):
    rows, want = [], set()
    for k, trace in enumerate(traces):
        open_ = []
        for i, (call, name) in enumerate(trace):
            rows.append((f"k{k}", i, "tool_call" if call else "tool_result", name))
            if call:
                open_.append((i, name))
            else:
                found = next((c for c in open_ if c[1] == name), None)
                if found:
                    open_.remove(found)
                    want.add((f"k{k}", name, found[0], i))
        want |= {(f"k{k}", n, i, None) for i, n in open_}
    df = spark.createDataFrame(rows, "key string, step long, kind string, name string")
    assert {tuple(r) for r in X.paired_calls(df).collect()} == want


def test_windows_and_chunks(spark):
    for n, size, stride in ((1, 4, 2), (4, 4, 2), (9, 4, 2), (10, 4, 3), (41, 40, 20)):
        df = spark.createDataFrame([("k", n)], "key string, steps long")
        got = sorted((r["start"], r["end"]) for r in S.step_windows(df, size, stride).collect())
        starts = [0] if n <= size else sorted({*range(0, n - size + 1, stride), n - size})
        assert got == [(s, min(s + size, n) - 1) for s in starts]
    steps = spark.createDataFrame([("k", i, "x" * c) for i, c in enumerate((5, 5, 20, 1, 1))], "key string, step long, content string")
    assert [r["chunk"] for r in S.greedy_chunks(steps, 10).orderBy("step").collect()] == [0, 0, 1, 2, 2]


def test_empty_trajectories(spark):
    df, _ = frame(spark, [[]])
    assert R.relations(df).count() == 0 and E.failure_runs(df).count() == 0
