import pytest
from pyspark.sql import functions as F

from trailmark.operators import evaluation as EV
from trailmark.operators import frames as V
from trailmark.operators import hunts as H
from trailmark.operators import sampling as M
from trailmark.operators import sinks as K
from trailmark.operators import stats as N
from trailmark.streaming import live


def test_replace_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    rows = lambda *r: spark.createDataFrame(r, "key string, rule string, v int")
    K.write_table(rows(("a", "x", 1), ("b", "x", 2), ("b", "y", 3)), spark.createDataFrame([("a",), ("b",)], "key string"), path)
    for _ in range(2):  # again and again gives the same table
        K.write_table(rows(("b", "x", 9)), spark.createDataFrame([("a",), ("b",)], "key string"), path, ("rule", ["x"]))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("b", "x", 9), ("b", "y", 3)]
    K.write_table(rows(), spark.createDataFrame([("b",)], "key string"), path)
    assert spark.read.parquet(path).count() == 0


def test_verdict_log(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    for worth, at in ((True, "1"), (False, "2")):
        K.append_verdict(spark, path, {"key": "k", "feature": "it's", "step": 1, "worth": worth, "note": "a\"b\\c", "at": at})
    got = N.latest_precision(K.read_verdicts(spark, path)).collect()
    assert [tuple(r) for r in got] == [("it's", 1, 0.0)]
    assert K.read_verdicts(spark, path).first()["note"] == "a\"b\\c"


def test_snapshot_repair(spark):
    saved = spark.createDataFrame([("k", 0, "a")], "key string, step long, content string")
    source = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b")], saved.schema)
    assert K.repaired(saved, source).count() == 2
    with pytest.raises(ValueError, match="differ"):
        K.repaired(saved, source.withColumn("content", F.lit("z")))


def test_bounds():
    lo, hi = N.wilson(2, 36)
    assert (round(lo, 4), round(hi, 4)) == (0.0154, 0.1814)
    assert round(N.upper_bound(0, 36), 4) == round(1 - 0.05 ** (1 / 36), 4)
    assert N.upper_bound(3, 3) == 1.0 and N.upper_bound(0, 0) == 1.0


def test_paths(spark):
    paths = spark.createDataFrame([("a", ["x", "1"]), ("a", ["x", "2"]), ("b", ["x", "1"]), ("c", ["y", "1"])], "key string, path array<string>")
    nodes = {tuple(r["node"]): (r["support"], r["events"]) for r in V.tree(paths).collect()}
    assert nodes[()] == (3, 4) and nodes[("x",)] == (2, 3) and nodes[("x", "1")] == (2, 2)
    cut = sorted((r["key"], tuple(r["node"])) for r in V.cut_paths(paths, 0.5).collect())
    assert cut == [("a", ("x",)), ("a", ("x", "1")), ("b", ("x", "1")), ("c", ())]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [5.0]), ("c", None)], "key string, v array<double>")
    got = {r["key"]: r["t"] for r in df.select("key", V.resampled("v", 3).alias("t")).collect()}
    assert got["a"] == [1.0, 2.0, 3.0] and got["b"] == [5.0, 5.0, 5.0] and got["c"] is None


def test_neighbours_in_blocks(spark):
    import random

    random.seed(1)
    rows = [(i, i % 2, [random.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, stratum int, vector array<double>")
    got = {(r["key"], r["rank"]): r["neighbour"] for r in N.nearest(df, "stratum", 3, block=7).collect()}
    for i, s, v in rows:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, t, w in rows if t == s and j != i)
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in order[:3]]


def test_ranks_over_ranges(spark):
    df = spark.range(50_000).select(F.col("id").alias("key"), (F.col("id") % 977).cast("double").alias("s"))
    got = N.ranked(df, "s", "key", parts=16)
    one = got.orderBy("rank").select("s", "key").collect()
    assert [r["rank"] for r in got.select("rank").orderBy("rank").collect()] == list(range(1, 50_001))
    assert [(-r["s"], r["key"]) for r in one] == sorted((-r["s"], r["key"]) for r in one)


def test_running_sums_over_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("n"))
    got = {(r["g"], r["x"]): r["n_upto"] for r in N.running(df, ["g"], "x", ["n"], parts=16, part_rows=100).collect()}
    total = {}
    for i in range(3000):
        total[i % 3] = total.get(i % 3, 0) + i % 7
        assert got[i % 3, float(i)] == total[i % 3]


def test_sampling(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").cast("double").alias("v"))
    got = M.sample(df, [M.Strategy("outlier", 5, column="v"), M.Strategy("target", 0.1, where="v < 50 & v >= 10"), M.Strategy("random")], 30).collect()
    assert len(got) == 30 and len({r["key"] for r in got}) == 30
    assert {r["key"] for r in got if r["strategy"] == "outlier"} == {"99", "98", "97", "96", "95"}
    assert M.translate("a == 1 & b > {f.x}", {"f.x": 2}) == "a = 1  AND  b > 2.0"
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "name string, w long")
    assert {r["name"]: r["share"] for r in M.apportion(weights, "w", "name", 4).collect()} == {"a": 2, "b": 1, "c": 1}


def test_dependence():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 1))
    assert EV.dependence(x, 2 * x) > 0.9 and EV.dependence(x, rng.normal(size=(200, 1))) < 0.3 and EV.dependence(x[:20], x[:20]) == 0.0
    figures = {"a": {"varying": 1.0, "noise": 0.0}, "b": {"varying": 1.0, "noise": 0.0}, "c": {"varying": 0.0, "noise": 0.0}}
    assert EV.roles(figures, {("a", "b"): 0.95}) == {"a": "distinguishing", "b": "dependent", "c": "invariant"}


def test_hunt(spark):
    steps = spark.createDataFrame([(f"k{i}", 0, "bad" if i % 10 == 0 else "good") for i in range(60)], "key string, step long, content string")
    population = steps.select("key", (F.xxhash64("key") % 5).alias("cluster"))
    probe = {"p": "SELECT key, step, content AS note FROM steps WHERE content = 'bad'"}
    reader = lambda drawn: drawn.select("key", F.regexp_extract("key", r"\d+", 0).cast("int").alias("i")).select("key", (F.col("i") % 10 == 0).alias("found"))
    state, verdicts = H.hunt_rounds(spark, {"steps": steps}, population, lambda s: probe if s.round == 0 else {}, reader, H.Hunt(reads=12, patience=1, max_rounds=3))
    assert state.found == {f"k{i}" for i in range(0, 60, 10)} and verdicts.groupBy("key").count().filter("count > 1").isEmpty()
    assert 0 < H.missed_bound(state) <= 1
    assert H.is_local(spark, "p", probe["p"], {"steps": steps})
    assert not H.is_local(spark, "q", "SELECT key, step, cast(count(*) OVER () AS STRING) AS note FROM steps", {"steps": steps})


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"))
    q = live.live_failure_runs(stream).writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user_id"], r["event_id"]) for r in spark.table("runs").collect()}
    want, length = set(), {}
    for r in events.filter("event_type IN ('click', 'purchase', 'error')").orderBy("ts", "event_id").collect():
        n = length[r["user_id"]] = length.get(r["user_id"], 0) + 1 if r["event_type"] == "error" else 0
        if n == 3:
            want.add((r["user_id"], r["event_id"]))
    assert got == want
    q = live.windowed(stream).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()


def test_layers():
    from pyspark.sql import types as T

    from trailmark.operators import layers as L

    made = lambda name, writes, reads=(): L.Layer(name, {writes: T.StructType([T.StructField("key", T.StringType(), True, {"comment": "whose"})])}, lambda t: {}, reads)
    known = L.registered({"a": made("a", "x", ("steps",)), "b": made("b", "y", ("x",)), "c": made("c", "z", ("y", "x"))}, {"a": made("a", "x", ("events",))})
    assert [x.name for x in L.plan(known, tables={"z"})] == ["a", "b", "c"] and known["a"].requires == ("events",)
    assert [x.name for x in L.plan(known, enabled={"a"})] == ["a"]
    assert "| key | string | whose |" in L.described(known)
    for bad in (lambda: L.plan(known, enabled={"q"}), lambda: L.plan(known, tables={"q"}), lambda: L.registered({"a": made("a", "x"), "b": made("b", "x")})):
        with pytest.raises(L.LayerError):
            bad()
    with pytest.raises(L.LayerError, match="each other"):
        L.plan(L.registered({"a": made("a", "x", ("y",)), "b": made("b", "y", ("x",))}), enabled={"a"})


def test_diverse_picks_round_by_round(spark):
    """Three groups far apart: the members nearest to each centre first, the largest group first, then the next nearest."""
    at = {"a": [0.0, 1.0, 2.0, 3.0, 4.0, 5.5], "b": [100.0, 101.0, 102.0, 105.0], "c": [200.0, 203.0]}
    rows = [(f"{g}{i}", x, 0.0) for g, xs in at.items() for i, x in enumerate(xs)]
    got = [r["key"] for r in M.diverse(spark.createDataFrame(rows, "key string, x double, y double"), ["x", "y"], 7, clusters=3, seed=1).collect()]
    want = []
    for turn in range(3):
        for g, xs in at.items():
            centre = sum(xs) / len(xs)
            near = sorted(range(len(xs)), key=lambda i, c=centre, xs=xs: (abs(xs[i] - c), i))
            want += [f"{g}{near[turn]}"] if turn < len(near) else []
    assert got == want[:7]


def test_dependences_tell_a_copy_from_noise(spark):
    rows = [(f"k{i}", float(i * 37 % 101), float(i * 53 % 97)) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, x double, noise double").withColumn("double", F.col("x") * 2)
    r = {(x["x"], x["y"]): x["r"] for x in EV.dependences(df, {"x": ["x"], "double": ["double"], "noise": ["noise"]}).collect()}
    assert len(r) == 6 and r["x", "double"] > 0.9 and r["double", "x"] > 0.9 and r["noise", "x"] < 0.5


def test_selection_and_attachment(spark):
    from trailmark.operators import review as RV

    index = spark.createDataFrame([("a", "d", 1), ("b", "d", 1), ("c", "e", 2)], "key string, dataset string, place int")
    assert [r["key"] for r in RV.selected(index, keys=["c", "a"], limit=1).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown keys"):
        RV.selected(index, keys=["a", "zz"])
    with pytest.raises(ValueError, match="there already"):
        RV.attached(index, index)


def test_kept_probes():
    good = '{"b": {"facet": "f", "kind": "sql", "source": "SELECT 1"}, "a": {"facet": "f", "kind": "code", "source": "x"}}'
    assert list(H.kept_probes(good, {"f"})) == ["a", "b"]
    for text, known in ((good, {"g"}), ('{"a": {"facet": "f"}}', {"f"}), (good.replace("sql", "perl"), {"f"})):
        with pytest.raises(H.SqlError):
            H.kept_probes(text, known)


def test_adapters_by_name():
    from trailmark.sources import adapters as A

    assert A.adapter("atif") is A.read_atif and A.adapter("atif", {"atif": A.read_messages}) is A.read_messages
    assert A.adapter("trailmark.sources.adapters:read_sessions") is A.read_sessions
    for bad in ("nothing", "trailmark.sources.adapters:nothing", "no.such.module:x"):
        with pytest.raises(A.Violation):
            A.adapter(bad)


def test_mining_rounds():
    """One is added, one revised once and then rejected, one fails, one has a bad name; two quiet rounds end it."""
    from trailmark.operators import mining as MI

    good = {"compared": 9, "noise": 0.0, "varying": 0.5, "distinct": 3, "examples": 2, "wrong": 0}

    def trial(name, spec):
        if name == "broken":
            raise MI.TrialError("no scope")
        return good | ({"noise": 0.5} if name == "noisy" else {})

    spec = {"type": "boolean"}
    proposals = [{"fine": spec, "noisy": spec, "Bad Name": spec}, {"noisy": spec, "broken": spec}, {}]
    state = MI.mine(lambda s: proposals[min(s.rounds, 2)], trial, {"old"})
    assert list(state.accepted) == ["fine"] and state.rounds == 3
    assert [(r, n, x) for r, n, x, _ in state.log] == [(0, "Bad Name", "reject"), (0, "fine", "add"), (0, "noisy", "revise"), (1, "broken", "reject"), (1, "noisy", "reject")]
    assert MI.settled(good | {"wrong": 1}, judged=False)[0] == "reject" and MI.settled(good | {"varying": 0.0})[0] == "reject"
    assert MI.settled(good | {"distinct": 500})[0] == "revise" and MI.settled(good | {"compared": 0})[0] == "reject"


def test_nearest_far_from_zero(spark):
    """neighbours go by the distances themselves, also where products of large values lose them, over many blocks."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = np.round(1e6 + rng.normal(size=(90, 4)), 3)
    v[40:60] = v[7]  # copies: ties by key
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "key long, stratum int, vector array<double>")
    want = set()
    for i in range(90):
        others = sorted((round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 9), j) for j in range(90) if j != i and j % 2 == i % 2)
        want |= {(i, j, rank) for rank, (_, j) in enumerate(others[:3], 1)}
    assert {(r["key"], r["neighbour"], r["rank"]) for r in N.nearest(df, "stratum", 3, block=8).collect()} == want
    assert "FlatMapGroupsInPandas" not in N.outliers(df, "stratum", 3)._jdf.queryExecution().optimizedPlan().toString()  # worked out once


def test_tree_counts_before_taking_apart(spark):
    """lines are joined in parts by their number, and counted by key and path before paths are taken apart."""
    from conftest import SF

    from trailmark.plans.catalogue import _paths

    paths = _paths(spark, SF, part_rows=500)
    assert paths.rdd.getNumPartitions() > 4
    found = V.tree(paths)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.index("Generate ") :]
    rows = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("a", ["x", "y"]), (None, ["x"]), ("b", []), ("b", None)], "key string, path array<string>")
    assert {("/".join(r["node"]), r["support"], r["events"]) for r in V.tree(rows).collect()} == {("", 2, 5), ("x", 1, 4), ("x/y", 1, 2)}
