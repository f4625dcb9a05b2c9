"""Registered queries over actions with files and commands, selections, indexes and hunt records; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import events as E
from trailmark.operators import features as X
from trailmark.operators import hunts as H
from trailmark.operators import mining as MI
from trailmark.operators import relations as R
from trailmark.operators import review as RV
from trailmark.operators import sinks as K
from trailmark.plans.catalogue import query, rounded
from trailmark.sources import adapters as A
from trailmark.sources.views import chat_steps, table, trace_actions, trace_steps

ORACLE: dict[str, str] = {}

# What stands for files, commands and unanswered calls: the number of an event says which.
_FILES = ("src/a.py", "tests/test_a.py", "pyproject.toml", "uv.lock", "docs/x.md", "src/b.py", "lib/c.go")


def worked_actions(spark, d):
    """The actions of traces with files of known roles, partial reads, undoing commands and unanswered calls."""
    a = trace_actions(spark, d)
    n = F.regexp_extract(F.col("paths")[0], r"(\d+)", 1).cast("int")
    twenty = F.regexp_extract("text", r"(\d+)", 1).cast("int")
    undoing = (F.col("act") == "run") & (twenty % 4 == 0)
    return (
        a.withColumn("n", n)
        .withColumn("paths", F.when(undoing & (twenty % 8 == 0), F.array().cast("array<string>")).when(undoing, F.array(F.lit("src"))).otherwise(F.array(F.element_at(F.array(*map(F.lit, _FILES)), F.col("n") + 1))))
        .withColumn("shape", F.when(twenty % 2 == 0, F.array(F.lit("range"))).otherwise(F.array().cast("array<string>")))
        .withColumn("subcommand", F.when(undoing, "checkout"))
        .withColumn("effect", F.when(undoing, "destructive").otherwise(F.col("effect")))
        .withColumn("act", F.when(undoing, "vcs").otherwise(F.col("act")))
        .withColumn("outcome", F.when((F.col("outcome") == "error") & (F.col("n") == 3), "unanswered").otherwise(F.col("outcome")))
        .drop("n")
    )


_WORKED = f"""w0 AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    wa AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY step) - 1 AS position, step AS call, k,
      CASE WHEN k % 5 = 3 AND k % 20 % 4 = 0 THEN 'vcs' ELSE list_extract(['read', 'edit', 'test', 'run', 'ask'], k % 5 + 1) END AS act, 'p' || (k % 4) AS program,
      CASE WHEN k % 5 = 3 AND k % 20 % 8 = 0 THEN NULL WHEN k % 5 = 3 AND k % 20 % 4 = 0 THEN 'src' ELSE list_extract([{', '.join(repr(f) for f in _FILES)}], k % 7 + 1) END AS path,
      k % 20 % 2 = 0 AS part, CASE WHEN event_type = 'error' AND k % 7 = 3 THEN 'unanswered' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome
      FROM w0 WHERE event_type IN ('click', 'purchase', 'error'))"""


@query
def w13_narrow(spark, d):
    return R.narrowed(worked_actions(spark, d))


ORACLE["w13_narrow"] = f"""WITH {_WORKED}, p AS (SELECT *, last_value(CASE WHEN act = 'read' AND NOT part THEN position END IGNORE NULLS) OVER (PARTITION BY key, path ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS whole FROM wa WHERE path IS NOT NULL)
    SELECT key, 'narrow' AS kind, position AS later, whole AS earlier FROM p WHERE act = 'read' AND part AND whole IS NOT NULL"""

_UNDO = """e AS (SELECT key, path, position, lead(position) OVER (PARTITION BY key, path ORDER BY position) AS again FROM wa WHERE act = 'edit'),
    un AS (SELECT u.key, u.position AS later, e.position AS earlier FROM wa u JOIN e ON e.key = u.key AND e.position < u.position AND (e.again IS NULL OR e.again > u.position)
      WHERE u.act = 'vcs' AND (u.path IS NULL OR e.path = u.path OR starts_with(e.path, u.path || '/')))"""


@query
def w15_undo(spark, d):
    return R.undone(worked_actions(spark, d))


ORACLE["w15_undo"] = f"WITH {_WORKED}, {_UNDO} SELECT key, 'undo' AS kind, later, earlier FROM un"


@query
def e1_unanswered(spark, d):
    return E.unanswered(worked_actions(spark, d)).select("key", "rule", "step", "recovered")


ORACLE["e1_unanswered"] = f"""WITH {_WORKED} SELECT a.key, 'result_unanswered' AS rule, a.call AS step, EXISTS (SELECT 1 FROM wa b WHERE b.key = a.key AND b.position > a.position AND b.outcome = 'ok' AND b.act = a.act AND b.path IS NOT DISTINCT FROM a.path AND a.path IS NOT NULL) AS recovered
    FROM wa a WHERE a.outcome = 'unanswered'"""


@query
def x13_last_verification(spark, d):
    a = worked_actions(spark, d)
    return X.action_features(a, R.relations(a)).select("key", "last_verification_failed", "undo_actions")


ORACLE["x13_last_verification"] = f"""WITH {_WORKED}, {_UNDO}, n AS (SELECT key, count(DISTINCT later) AS undo_actions FROM un GROUP BY key), l AS (SELECT key, arg_max(outcome = 'error', position) FILTER (act = 'test') AS last_verification_failed FROM wa GROUP BY key)
    SELECT key, last_verification_failed, CAST(coalesce(undo_actions, 0) AS BIGINT) AS undo_actions FROM l LEFT JOIN n USING (key)"""


@query
def x23_edited_roles(spark, d):
    return rounded(X.edited_roles(worked_actions(spark, d)), "test_edit_share", "config_edit_share")


ORACLE["x23_edited_roles"] = f"""WITH {_WORKED}, f AS (SELECT DISTINCT key, path FROM wa WHERE act = 'edit')
    SELECT key, round(avg((path = 'tests/test_a.py')::INT)::DOUBLE, 6) AS test_edit_share, round(avg((path IN ('pyproject.toml', 'uv.lock'))::INT)::DOUBLE, 6) AS config_edit_share FROM f GROUP BY key"""


@query
def x25_unknown_programs(spark, d):
    a = worked_actions(spark, d).withColumn("act", F.when(F.col("program") == "p3", "other").otherwise(F.col("act")))
    return rounded(X.unknown_programs(a), "unknown_program_share")


ORACLE["x25_unknown_programs"] = f"WITH {_WORKED} SELECT key, round(avg((program = 'p3')::INT)::DOUBLE, 6) AS unknown_program_share FROM wa GROUP BY key"


@query
def s6a_path_metadata(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.get_json_object(A.path_metadata(F.col("url"), r"^https?://(?P<host>[^/?]+)/(?P<lang>\w\w)/"), "$.lang").alias("lang"))


ORACLE["s6a_path_metadata"] = r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?]+/\w\w/') THEN regexp_extract(url, '^https?://[^/?]+/(\w\w)/', 1) END AS lang FROM pages"


def _index(spark, d):
    steps = chat_steps(spark, d).withColumn("dataset", F.concat(F.lit("d"), F.col("key").cast("long") % 3)).withColumn("content", F.coalesce("content", F.lit("")))
    return A.index_of(steps, ["d2", "d0"])


_INDEXED = """ix AS (SELECT CAST(conv_id AS VARCHAR) AS key, 'd' || (conv_id % 3) AS dataset, CASE conv_id % 3 WHEN 2 THEN 1 ELSE 2 END AS place, count(*) AS n_steps, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars,
    sha256(string_agg(role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE conv_id % 3 <> 1 GROUP BY conv_id)"""


@query
def s11_index(spark, d):
    return _index(spark, d).select("key", "dataset", F.col("place").cast("int").alias("place"), "n_steps", "chars", "digest")


ORACLE["s11_index"] = f"WITH {_INDEXED} SELECT key, dataset, CAST(place AS INT) AS place, n_steps, chars, digest FROM ix"


@query
def p3_selection(spark, d):
    return RV.selected(_index(spark, d), datasets=["d0", "d2"], limit=25).select("key", "dataset")


ORACLE["p3_selection"] = f"WITH {_INDEXED} SELECT key, dataset FROM ix ORDER BY place, key LIMIT 25"


@query
def p12_reference(spark, d):
    index = _index(spark, d)
    return RV.reference_set(index, ["d2"], index.filter("n_steps < 4")).select("key")


ORACLE["p12_reference"] = f"WITH {_INDEXED} SELECT key FROM ix WHERE dataset = 'd2' AND n_steps >= 4"


@query
def n11_context(spark, d):
    index = _index(spark, d)
    batches = index.filter("n_steps > 4").select("key", F.concat(F.lit("b"), F.col("n_steps") % 2).alias("batch"), F.lit("s").alias("stratum"))
    return RV.context_frame(index, index.select("key", (F.col("chars") % 3).alias("size")), batches)


ORACLE["n11_context"] = f"WITH {_INDEXED} SELECT key, dataset, chars % 3 AS size, CASE WHEN n_steps > 4 THEN 'b' || (n_steps % 2) END AS batch, CASE WHEN n_steps > 4 THEN 's' END AS stratum FROM ix"


@query
def v16_attached(spark, d):
    view = _index(spark, d).select("key", "n_steps")
    return RV.attached(view, view.filter("n_steps > 5").select("key", (F.col("n_steps") / 10).alias("anomaly")))


ORACLE["v16_attached"] = f"WITH {_INDEXED} SELECT key, n_steps, CASE WHEN n_steps > 5 THEN n_steps / 10.0::DOUBLE END AS anomaly FROM ix"


@query
def a15_distinct_values(spark, d):
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") > 80, F.col("event_type"))).alias("kinds"))
    return RV.distinct_values(sets, "kinds", "set")


ORACLE["a15_distinct_values"] = "WITH s AS (SELECT user_id, coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (value > 80))), ','), '') AS v FROM events GROUP BY 1) SELECT count(DISTINCT v) AS distinct_values FROM s"


@query
def u7_measured(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), "event_type").agg(F.when(F.count("*") % 3 == 0, "failed").otherwise("ok").alias("status"))
    return RV.measured(*[e.filter(F.col("event_type") == t) for t in ("click", "view", "error")])


ORACLE["u7_measured"] = "WITH s AS (SELECT user_id AS key, event_type FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2 HAVING count(*) % 3 <> 0) SELECT key FROM s GROUP BY key HAVING count(*) = 3"


@query
def k1a_scoped_replace(spark, d):
    old = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus")
    new = old.filter("key % 5 = 0 AND o_orderstatus = 'F'").withColumn("o_orderkey", -F.col("o_orderkey"))
    return K.replaced(old, new, old.filter("key % 5 < 2").select("key"), ("o_orderstatus", ["F"]))


ORACLE["k1a_scoped_replace"] = "SELECT o_custkey AS key, o_orderkey, o_orderstatus FROM orders WHERE NOT (o_custkey % 5 < 2 AND o_orderstatus = 'F') UNION ALL SELECT o_custkey, -o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'F'"


def _hits(spark, d):
    return H.code_probe("slow", {"steps": trace_steps(spark, d)}, lambda t: t["steps"].filter("value > 95").select("key", "step", F.lit("high").alias("note")))


def _readings(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("n")).filter("cast(key AS LONG) % 3 = 0")
    return e.select("key", (F.col("n") % 4).alias("round"), (F.col("n") % 2 == 0).alias("found"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("f"), F.col("n") % 3)).alias("facet"))


_HIT = """tr AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value FROM events), hit AS (SELECT key, step FROM tr WHERE value > 95),
    rd AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) % 4 AS round, count(*) % 2 = 0 AS found, CASE WHEN count(*) % 2 = 0 THEN 'f' || (count(*) % 3) END AS facet FROM events WHERE user_id % 3 = 0 GROUP BY user_id)"""


@query
def h3_code_probe(spark, d):
    return _hits(spark, d)


ORACLE["h3_code_probe"] = f"WITH {_HIT} SELECT 'slow' AS probe, key, step, 'high' AS note FROM hit"


@query
def h4_misplaced(spark, d):
    lengths = trace_steps(spark, d).groupBy("key").agg((F.count("*") - 5).alias("steps")).filter("cast(key AS LONG) % 4 <> 0")
    return H.misplaced(_hits(spark, d), lengths)


ORACLE["h4_misplaced"] = f"WITH {_HIT}, l AS (SELECT key, count(*) - 5 AS steps FROM tr WHERE CAST(key AS BIGINT) % 4 <> 0 GROUP BY key) SELECT 'slow' AS probe, hit.key, step FROM hit LEFT JOIN l ON l.key = hit.key WHERE steps IS NULL OR step >= steps"


@query
def h12_confirmed_cases(spark, d):
    draws = _readings(spark, d).select("key", F.when(F.col("key").cast("long") % 2 == 0, "hit").otherwise("random").alias("source"))
    return rounded(H.confirmed_cases(_readings(spark, d), draws), "share")


ORACLE["h12_confirmed_cases"] = f"WITH {_HIT} SELECT round, CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN 'hit' ELSE 'random' END AS source, count(*) AS read, count(*) FILTER (found) AS found, round(avg(found::INT)::DOUBLE, 6) AS share FROM rd GROUP BY 1, 2"


@query
def h15_tried(spark, d):
    return H.tried(_hits(spark, d), _readings(spark, d))


ORACLE["h15_tried"] = f"""WITH {_HIT}, h AS (SELECT DISTINCT key FROM hit), j AS (SELECT h.key IS NOT NULL AS hit, rd.found FROM h FULL JOIN rd ON rd.key = h.key)
    SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND found IS NOT NULL) AS read, count(*) FILTER (hit AND found) AS found, count(*) FILTER (NOT hit AND found) AS missed FROM j"""


@query
def h16_verdict_table(spark, d):
    return H.verdict_table("slow calls", _readings(spark, d), _hits(spark, d))


ORACLE["h16_verdict_table"] = f"WITH {_HIT} SELECT 'slow calls' AS hunt, rd.key, round, found, facet, CASE WHEN rd.key IN (SELECT key FROM hit) THEN 'slow' ELSE '' END AS probes FROM rd"


def _values(spark, d, by):
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return e.select("key", F.concat(F.lit("v"), F.floor(F.col("n") / by) % 3).alias("value"))


@query
def g3_trial_figures(spark, d):
    first, second = _values(spark, d, 1), _values(spark, d, 2)
    sample = first.filter("cast(key AS LONG) % 2 = 0").select("key")
    examples = first.filter("cast(key AS LONG) < 6").withColumn("value", F.when(F.col("key") == "4", "v9").otherwise(F.col("value")))
    return rounded(MI.trial_figures(first, second, sample, examples, "category"), "noise", "varying")


ORACLE["g3_trial_figures"] = """WITH v AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1), p AS (SELECT k, n % 3 AS x, CAST(floor(n / 2) AS BIGINT) % 3 AS y FROM v), s AS (SELECT * FROM p WHERE k % 2 = 0),
    t AS (SELECT x, count(*) AS n FROM s GROUP BY x)
    SELECT (SELECT count(*) FROM s) AS compared, (SELECT round(avg((x <> y)::INT), 6) FROM s) AS noise, (SELECT round(1 - max(n) / sum(n), 6) FROM t) AS varying, (SELECT count(*) FROM t) AS "distinct",
      (SELECT count(*) FROM p WHERE k < 6) AS examples, (SELECT count(*) FROM p WHERE k = 4) AS wrong"""


@query
def g4_trial_sample(spark, d):
    population = _values(spark, d, 1)
    chosen = population.filter("cast(key AS LONG) % 10 = 1")
    return MI.trial_sample(population, chosen, population.filter("key IN ('2', '3')"), 12, seed=4, scope="value <> 'v0'", least=2)


ORACLE["g4_trial_sample"] = """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id HAVING count(*) % 3 <> 0), h AS (SELECT key FROM p WHERE CAST(key AS BIGINT) % 10 = 1 ORDER BY key LIMIT 12),
    r AS (SELECT key, row_number() OVER (ORDER BY md5('4:' || key), key) AS n FROM p WHERE key NOT IN (SELECT key FROM h) AND key NOT IN ('2', '3'))
    SELECT key, true AS held_out FROM h UNION ALL SELECT key, false FROM r WHERE n <= 12 - (SELECT count(*) FROM h)"""


@query
def r1_catalogue(spark, d):
    return MI.catalogue({"steps": chat_steps(spark, d), "orders": table(spark, d, "orders").select("o_orderkey", "o_totalprice")})


ORACLE["r1_catalogue"] = """SELECT * FROM (VALUES ('orders', 0, 'o_orderkey', 'bigint', ''), ('orders', 1, 'o_totalprice', 'double', ''), ('steps', 0, 'key', 'string', ''), ('steps', 1, 'step', @TURN, ''), ('steps', 2, 'role', 'string', ''),
    ('steps', 3, 'kind', 'string', ''), ('steps', 4, 'name', 'string', ''), ('steps', 5, 'content', 'string', ''), ('steps', 6, 'timestamp', 'timestamp', '')) AS t("table", position, "column", "type", comment)""".replace("@TURN", "(SELECT CASE WHEN typeof(any_value(turn)) = 'BIGINT' THEN 'bigint' ELSE 'int' END FROM conversations)")


@query
def r13_hunt_rows(spark, d):
    marks = _hits(spark, d).select("key", F.lit("slow").alias("facet"), "step")
    batches = _readings(spark, d).select("key", F.concat(F.lit("b"), F.col("round")).alias("batch"))
    return MI.hunt_rows(_readings(spark, d), marks, batches)


ORACLE["r13_hunt_rows"] = f"""WITH {_HIT}, m AS (SELECT key, count(*) AS marks, min(step) AS first_mark FROM hit GROUP BY key)
    SELECT coalesce(rd.key, m.key) AS key, CASE WHEN rd.found IS NULL THEN 'unread' WHEN rd.found THEN 'found' ELSE 'rejected' END AS status, facet, coalesce(marks, 0) AS marks, first_mark, 'b' || round AS batch FROM rd FULL JOIN m ON m.key = rd.key"""


@query
def r13_hunts(spark, d):
    return MI.hunts_list(H.verdict_table("slow calls", _readings(spark, d), _hits(spark, d)))


ORACLE["r13_hunts"] = f"WITH {_HIT} SELECT 'slow calls' AS hunt, max(round) + 1 AS rounds, count(*) AS read, count(*) FILTER (found) AS found, count(DISTINCT facet) FILTER (found) AS facets FROM rd"
