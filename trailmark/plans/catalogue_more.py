"""More registered queries: joins, sets, review, sinks, judgments, hunts, sampling, parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import evaluation as EV
from trailmark.operators import events as E
from trailmark.operators import features as X
from trailmark.operators import review as RV
from trailmark.operators import sampling as M
from trailmark.operators import sinks as K
from trailmark.operators import stats as N
from trailmark.plans.catalogue import query, rounded, trace_turns
from trailmark.sources.views import chat_steps, table, trace_actions, trace_steps
from trailmark.streaming import live


def judgments(spark, d):
    """Answers per unit that stand for a model's: each conversation turn judged by the length of its text."""
    t = table(spark, d, "conversations").filter("role = 'user'")
    value = F.when(F.length("text") % 3 == 0, "pushback").when(F.length("text") % 3 == 1, "approval").otherwise("neutral")
    return t.select(F.col("conv_id").cast("string").alias("key"), F.lit("reaction").alias("feature"), F.col("turn").alias("index"), F.col("turn").alias("start"), F.col("turn").alias("end"), value.alias("value"), F.lit(None).cast("string").alias("evidence"))


@query
def j10_semi(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    c = table(spark, d, "customer").filter("c_acctbal > 5000").withColumnRenamed("c_custkey", "key")
    return RV.having(o, c).select("o_orderkey", "key")


@query
def j11_anti(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    return RV.having(c, without=(table(spark, d, "orders").withColumnRenamed("o_custkey", "key"),)).select("key", "c_name")


@query
def p10_exists_filters(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    return RV.having_any(c, o.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 400000"), o.filter("o_orderstatus = 'P' AND o_totalprice > 350000")).select("key", "c_name")


@query
def u5_multiset_diff(spark, d):
    e = table(spark, d, "events")
    return e.filter("value < 60").select("user_id", "event_type").exceptAll(e.filter("value >= 60").select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query
def u6_symdiff(spark, d):
    e = table(spark, d, "events")
    a, b = e.filter("value < 50").select("user_id", "event_type"), e.filter("value >= 50").select("user_id", "event_type")
    return RV.symmetric_difference(a, b).groupBy("user_id", "event_type", "side").agg(F.count("*").alias("n"))


@query
def o1_paged_sort(spark, d):
    return RV.page(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 50, 3).select("o_orderkey", "o_totalprice")


@query
def o3_topk_columns(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") - 25.0).alias("size"), ((F.col("p_retailprice") - 1000) / 40.0).alias("price"), (F.col("p_partkey") % 31 - 15.0).alias("place"))
    top = M.top_reasons(parts, ["size", "price", "place"], 2)
    return top.select("key", F.col("reasons")[0]["column"].alias("first"), F.col("reasons")[1]["column"].alias("second"))


@query
def p9_search_filter(spark, d):
    return RV.search(table(spark, d, "documents"), columns={"text": "LICENSE", "lang": "EN"}).select("doc_id", "lang")


@query
def w20_first_n(spark, d):
    e = E.unasked_side_effects(trace_actions(spark, d)).unionByName(E.failure_runs(trace_actions(spark, d)))
    return RV.first_per_key(e, 6, "step", "rule").select("key", "rule", "step")


@query
def w21_last_judgment(spark, d):
    return RV.last_judgment(judgments(spark, d))


@query
def a10_unit_aggregates(spark, d):
    j = judgments(spark, d)
    parts = [X.judged(j, "reaction", k, of).withColumnRenamed("reaction", k) for k, of in (("share", ["pushback"]), ("any", ["approval"]), ("count", ["neutral"]), ("first", None), ("last", None))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "key")
    return rounded(out, "share")


@query
def e7_judged_events(spark, d):
    return E.judged_events(judgments(spark, d), "reaction", ["pushback"]).select("key", "rule", "step")


@query
def a12_latest_verdict_precision(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("key"), (F.col("value") > 40).alias("worth"), F.col("event_id").alias("line"))
    return rounded(N.latest_precision(e), "precision")


@query
def h9_probe_ledger(spark, d):
    e = table(spark, d, "events")
    hits = e.filter("value > 97").select(F.col("event_type").alias("probe"), F.col("user_id").alias("key"))
    reads = e.groupBy(F.col("user_id").alias("key")).agg((F.count("*") % 2 == 0).alias("found")).filter("key % 3 <> 0")
    return rounded(N.probe_ledger(hits, reads), "precision")


@query
def f28_apportion(spark, d):
    weights = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return M.apportion(weights, "w", "source", 37).select("source", "w", "share")


@query
def k1_replace_by_key(spark, d):
    old = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus")
    covered = old.filter("key % 3 = 0").select("key").distinct()
    new = old.filter("key % 6 = 0").withColumn("o_orderstatus", F.lit("N"))
    return K.replaced(old, new, covered).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query
def k2_feature_rows(spark, d):
    e = table(spark, d, "events")
    long = e.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("feature")).agg(F.max("value").alias("value"), F.when(F.count("*") % 5 == 0, "failed").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("detail"))
    return K.feature_rows(long, ["click", "error"]).select("key", "click", "click__status", "error", "error__status")


@query
def a11_coverage(spark, d):
    e = table(spark, d, "events")
    long = e.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("feature")).agg(F.when(F.count("*") % 5 == 0, "failed").otherwise("ok").alias("status"))
    return K.coverage(long).select("feature", "ok", "failed")


@query
def r3_label_expansion(spark, d):
    return RV.expanded(X.tool_usage(trace_steps(spark, d)), "tool_errors")


@query
def r6_group_compare(spark, d):
    return rounded(RV.compared(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "mean"), "value", digits=4)


@query
def r9_course(spark, d):
    marks = E.failure_runs(trace_actions(spark, d)).select("key", "step", F.col("rule").alias("label"))
    return RV.course(trace_turns(spark, d), marks).select("key", "index", F.size("marks").cast("long").alias("marks"))


@query
def a25_typical(spark, d):
    return RV.typical(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "category")


@query
def n18_tail_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice", "o_orderstatus")
    return EV.tail_counts(o, o.filter("o_orderstatus = 'F'"), "o_totalprice")


@query
def n24_median_labels(spark, d):
    return EV.median_labels(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice"), "o_totalprice").groupBy("label").agg(F.count("*").alias("n"))


@query
def q_sql_bridge(spark, d):
    from trailmark.functions.sqltext import run_query

    sql = "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS dear, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM 'orders.parquet' GROUP BY ALL"
    return run_query(spark, sql, {"orders": table(spark, d, "orders")})


@query
def q_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query
def z_hourly_windows(spark, d):
    return rounded(live.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "total", digits=2)


@query
def z_sessions(spark, d):
    s = live.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query
def m4_diversity(spark, d):
    e = table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    e = e.select(F.col("vec_id").alias("key"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(size)])
    return M.diverse(e, [f"v{i}" for i in range(size)], 20, clusters=8, seed=1).select("key", "cluster")


@query
def n15_dependence(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), "o_totalprice", (F.col("o_totalprice") * 2).alias("doubled"), "c_acctbal")
    return rounded(EV.dependences(EV.evaluation_set(o, 100), {"price": ["o_totalprice"], "doubled": ["doubled"], "balance": ["c_acctbal"]}), "r")


@query
def k12_restricted(spark, d):
    rows = chat_steps(spark, d).groupBy("key").agg(F.to_json(F.create_map(F.lit("secret_a"), F.count("*").cast("string"), F.lit("steps"), F.count("*").cast("string"))).alias("metadata"))
    return K.restricted(rows, rows.filter("cast(key AS INT) % 2 = 0"), ["secret*"]).select("key", F.get_json_object("metadata", "$.steps").alias("steps"), F.get_json_object("metadata", "$.secret_a").alias("secret"))
