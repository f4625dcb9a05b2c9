"""Registered queries: operators bound to the driver tables.  Keys carry the operator's ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.operators import events as E
from trailmark.operators import features as X
from trailmark.operators import frames as V
from trailmark.operators import relations as R
from trailmark.operators import stats as N
from trailmark.operators import steps as S
from trailmark.operators import turns as T
from trailmark.plans.oracle import ORACLE
from trailmark.sources.views import chat_steps, table, trace_actions, trace_steps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def queries() -> dict[str, Query]:
    import trailmark.plans.catalogue_more  # noqa: F401  registers the rest
    import trailmark.plans.catalogue_cases  # noqa: F401
    import trailmark.plans.catalogue_texts  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from trailmark.plans.catalogue_cases import ORACLE as OF_CASES
    from trailmark.plans.catalogue_texts import ORACLE as OF_TEXTS

    known = queries()
    return {k: v for k, v in (ORACLE | OF_TEXTS | OF_CASES).items() if k in known}


def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, which have no actions."""
    nothing = trace_actions(spark, d).limit(0)
    return T.turn_summary(chat_steps(spark, d), nothing)


def trace_turns(spark: SparkSession, d: str) -> DataFrame:
    return T.turn_summary(trace_steps(spark, d), trace_actions(spark, d))


@query
def p1_steps_running_turn(spark, d):
    return S.with_turns(chat_steps(spark, d), cut=100).select("key", "step", "role", "turn", "chars", "content")


@query
def p2_trajectories(spark, d):
    return S.trajectories(chat_steps(spark, d))


@query
def w1_turn_cut(spark, d):
    return S.cut_turns(chat_steps(spark, d))


@query
def w2_step_windows(spark, d):
    return S.step_windows(S.trajectories(trace_steps(spark, d)), 40, 20)


@query
def w3_greedy_chunks(spark, d):
    return S.greedy_chunks(chat_steps(spark, d), 1500)


@query
def w4_last_request(spark, d):
    return S.last_request(chat_steps(spark, d))


@query
def w5_context_before(spark, d):
    return S.context_before(chat_steps(spark, d), 2)


@query
def w7_action_moves(spark, d):
    moves = X.action_moves(trace_actions(spark, d)).select("key", F.posexplode("action_moves").alias("at", "m"))
    return moves.select("key", F.col("at").cast("long").alias("at"), F.col("m")[0].alias("after"), F.col("m")[1].alias("act"))


@query
def w8_interjections(spark, d):
    return S.interjections(trace_steps(spark, d))


@query
def k5_rendered(spark, d):
    return S.rendered(chat_steps(spark, d)).select("key", F.length("markdown").cast("long").alias("chars"), "sha256")


@query
def t6_turns(spark, d):
    return chat_turns(spark, d).select("key", "index", "start", "end", "prompt_chars", "steps", "messages", "ended_by")


@query
def t6_trace_turns(spark, d):
    df = trace_turns(spark, d).select("key", "index", "start", "end", "notices", "steps", "calls", "actions", "edits", "verifications", "asks", "side_effects", "failed_calls", "duration_s", "ended_by", "first_act", "last_act")
    return rounded(df, "duration_s", digits=3)


@query
def a5_oversight(spark, d):
    df = T.oversight(trace_turns(spark, d).withColumn("batch", F.col("key").cast("long") % 5), "batch")
    return rounded(df, "ask_share", "interrupt_share", "duration_p50", "duration_p99", "calls_per_turn", digits=3)


@query
def a26_turn_stats(spark, d):
    return T.turn_stats(trace_turns(spark, d))


@query
def x1_basic(spark, d):
    return rounded(X.basic(trace_steps(spark, d)), "duration_minutes", digits=4)


@query
def x2_tool_usage(spark, d):
    df = X.tool_usage(trace_steps(spark, d))
    return rounded(df.select("key", "n_tool_calls", "tool_error_rate", *[F.coalesce(F.col("tool_calls")[t], F.lit(0)).cast("long").alias(f"calls_{t}") for t in ("tool0", "tool1", "tool2")]), "tool_error_rate")


@query
def x3_tool_paths(spark, d):
    paths = X.tool_paths(trace_actions(spark, d)).select("key", F.explode("tool_paths").alias("p"))
    return paths.groupBy("key", F.col("p")[0].alias("tool"), F.col("p")[1].alias("outcome")).agg(F.count("*").alias("n"))


@query
def x4_dialogue(spark, d):
    return rounded(X.dialogue(chat_steps(spark, d)), "short_prompt_share", "prompt_chars_median")


@query
def x7_action_features(spark, d):
    a = trace_actions(spark, d)
    df = X.action_features(a, R.relations(a)).drop("undo_actions", "last_verification_failed")
    return rounded(df, "reedit_share", "edit_verified_share", "verification_failure_share", "call_failure_share", "retry_share", "explore_share", "shell_commands_per_call")


@query
def x9_seen_share(spark, d):
    a = trace_actions(spark, d)
    return rounded(X.seen_share(a, R.seen_and_reedited(a)), "edit_seen_share")


@query
def x17_recovery_share(spark, d):
    return rounded(X.recovery_share(trace_actions(spark, d)), "recovery_share")


@query
def w9_repeat(spark, d):
    return R.repeats_and_retries(trace_actions(spark, d)).filter("kind = 'repeat'")


@query
def w10_retry(spark, d):
    return R.repeats_and_retries(trace_actions(spark, d)).filter("kind = 'retry'")


@query
def w11_seen(spark, d):
    return R.seen_and_reedited(trace_actions(spark, d)).filter("kind = 'seen'")


@query
def w12_reedit(spark, d):
    return R.seen_and_reedited(trace_actions(spark, d)).filter("kind = 'reedit'")


@query
def w14_verify(spark, d):
    return R.verified(trace_actions(spark, d))


@query
def w16_recovery(spark, d):
    a = trace_actions(spark, d)
    broken = a.filter("outcome = 'error'").select("key", "position")
    return E.recoveries(a, broken).select("key", "position", "recovered_position")


@query
def e2_blind_retry(spark, d):
    return E.blind_retries(trace_actions(spark, d))


@query
def e3_unasked(spark, d):
    return E.unasked_side_effects(trace_actions(spark, d)).select("key", "rule", "step")


@query
def e4_failure_run(spark, d):
    return E.failure_runs(trace_actions(spark, d))


@query
def e5_interrupted(spark, d):
    return E.interrupted_turns(trace_turns(spark, d)).select("key", "rule", "step")


@query
def j4_event_in_turn(spark, d):
    return E.events_in_turns(E.failure_runs(trace_actions(spark, d)), S.cut_turns(trace_steps(spark, d)))


@query
def a1_profile(spark, d):
    return rounded(N.profile(table(spark, d, "orders"), "o_orderstatus", "o_totalprice"), "mean", "median", "p90", digits=4)


@query
def a2_histogram(spark, d):
    return rounded(N.histogram(table(spark, d, "orders"), "o_totalprice", 40), "start", digits=4)


@query
def a6_spread(spark, d):
    return rounded(N.spread(table(spark, d, "documents"), "source", 8), "share")


@query
def a7_explained(spark, d):
    return rounded(N.variance_explained(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice"), "explained")


@query
def a8_shift_effect(spark, d):
    return N.shifts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["o_totalprice"]).drop("direction")


@query
def n3_ks(spark, d):
    return rounded(N.ks_statistic(table(spark, d, "orders"), "o_orderstatus", F.col("o_orderpriority") == "1-URGENT", "o_totalprice"), "ks")


def _followed(spark, d):
    turns = trace_turns(spark, d)
    bad = E.failure_runs(trace_actions(spark, d)).select("key", "step")
    starts = turns.select("key", F.col("start").alias("step")).join(bad, ["key", "step"], "left_semi")
    return N.consequences(turns, starts)


@query
def w18_consequences(spark, d):
    return _followed(spark, d).select("key", "index", "followed")


@query
def a13_lift(spark, d):
    a = trace_actions(spark, d)
    located = E.events_in_turns(E.failure_runs(a).unionByName(E.unasked_side_effects(a)), S.cut_turns(trace_steps(spark, d)))
    followed = _followed(spark, d)
    strata = followed.select("key", (F.col("key").cast("long") % 2).alias("stratum")).distinct()
    return rounded(N.lifts(located, followed, strata), "followed", "baseline", "lift")


@query
def a14_jaccard_noise(spark, d):
    one = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set(F.when(F.col("value") < 50, F.col("event_type")))).alias("x"), F.array_sort(F.collect_set(F.when(F.col("value") >= 50, F.col("event_type")))).alias("y"))
    return rounded(one.select("key", N.disagreement("set", "x", "y").alias("noise")), "noise")


@query
def a23_confusion(spark, d):
    return N.confusion(table(spark, d, "labels"), "quality", "toxic")


@query
def a23_kappa(spark, d):
    return rounded(N.kappa(table(spark, d, "labels"), "quality", "toxic"), "agreement", "kappa")


@query
def j9_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("stratum"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(N.nearest(v, "stratum", 10), "distance", digits=5)


@query
def n7_outlier(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("stratum"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(N.outliers(v, "stratum", 10), "outlier", digits=5)


@query
def n8_anomaly_rank(spark, d):
    a = trace_actions(spark, d)
    events = E.failure_runs(a).unionByName(E.unasked_side_effects(a))
    lift = a13_lift(spark, d).select("rule", "lift")
    keys = S.trajectories(trace_steps(spark, d)).select("key", (F.col("steps") % 7 / 10.0).cast("double").alias("outlier"))
    scored = N.anomaly_scores(keys, events, lift)
    return rounded(N.ranked(scored.withColumn("anomaly_score", F.round("anomaly_score", 9)), "anomaly_score", "key"), "events_score", "anomaly_score").select("key", "events_score", "anomaly_score", "rank")


@query
def n1_quartile_batches(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(N.quartile_labels(o, "o_totalprice").alias("batch"), F.col("o_orderstatus").alias("stratum")).agg(F.count("*").alias("n"))


@query
def n17_surprisal(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.col("doc_id"))
    return rounded(N.surprisal(docs, docs.filter("doc_id % 2 = 0"), "lang"), "surprisal")


@query
def n21_drift(spark, d):
    o = table(spark, d, "orders")
    side = F.col("o_orderstatus") == "F"
    return rounded(N.jensen_shannon(N.decile_bins(o, o.filter(side), "o_totalprice"), "bin", side), "divergence")


@query
def n25_spearman(spark, d):
    return rounded(N.spearman(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"), "rho")


def _paths(spark, d, part_rows=500_000):
    """key and path of each line; a task joins and sorts some ``part_rows`` lines, however many there are."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = max(spark.sparkContext.defaultParallelism, li.count() // part_rows)
    li, o = li.select("l_orderkey", "l_returnflag", "l_linestatus").repartition(parts, "l_orderkey"), o.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("key"), F.array("l_returnflag", "l_linestatus").alias("path"))


@query
def v9_tree_support(spark, d):
    return V.tree(_paths(spark, d)).select(F.array_join("node", "/").alias("node"), F.col("depth").cast("long").alias("depth"), "support", "events")


@query
def v10_cut_shares(spark, d):
    return rounded(V.node_shares(V.cut_paths(_paths(spark, d), 0.99), 2), "share")


@query
def v12_rare_share(spark, d):
    return rounded(V.rare_share(V.cut_paths(_paths(spark, d), 0.99), 2), "rare_share")


@query
def a17_level_entropy(spark, d):
    return rounded(V.level_entropy(_paths(spark, d)).withColumn("depth", F.col("depth").cast("long")), "bits")


@query
def n20_level_surprisal(spark, d):
    p = _paths(spark, d)
    df = V.level_surprisal(p, p.filter("key % 2 = 0"))
    return rounded(df.withColumn("depth", F.col("depth").cast("long")), "surprisal")


@query
def v3_onehot(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *V.one_hot("lang", V.labels_of(docs, "lang")))


@query
def v4_multihot(spark, d):
    events = table(spark, d, "events")
    sets = events.groupBy(F.col("user_id").alias("key")).agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("kinds"))
    return sets.select("key", *V.multi_hot("kinds", V.labels_of(events, "event_type")))


@query
def v5_map_columns(spark, d):
    usage = X.tool_usage(trace_steps(spark, d))
    return usage.select("key", *V.map_columns("tool_errors", ["tool0", "tool1", "tool2"]))


@query
def v6_vector_aggs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    df = e.select("key", *V.vector_aggregates("embedding"), *[V.resampled("embedding", 5)[i].alias(f"t{i}") for i in range(5)])
    return rounded(df, *[c for c in df.columns if c != "key"], digits=5)


@query
def v8_first_unrecovered(spark, d):
    a = trace_actions(spark, d)
    return V.first_unrecovered(E.failure_runs(a).unionByName(E.unasked_side_effects(a)))


@query
def v15_scaling(spark, d):
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).cast("double").alias("nation"))
    df = V.scaled(o, {"balance": ["c_acctbal"], "nation": ["nation"]})
    return rounded(df, *[c for c in df.columns if c != "key"], digits=5)


@query
def j1_features_view(spark, d):
    index = S.trajectories(trace_steps(spark, d)).select("key")
    joined = V.join_groups(index, [X.basic(trace_steps(spark, d)), X.recovery_share(trace_actions(spark, d))])
    return rounded(joined.select("key", "n_steps", "total_chars", "recovery_share"), "recovery_share")
