"""The registered queries in DuckDB SQL, written from their definitions."""

from __future__ import annotations

_CHAT = "steps AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS step, role, 'message' AS kind, text AS content FROM conversations)"
_TRACE = """tr AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type,
      value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events),
    st AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY step) AS turn,
      CASE WHEN event_type = 'view' THEN 'message' WHEN event_type = 'signup' THEN 'notice' ELSE 'tool_call' END AS kind FROM tr),
    act AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY step) - 1 AS position, step AS call, turn, 'tool' || (k % 3) AS tool,
      CASE k % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'test' WHEN 3 THEN 'run' ELSE 'ask' END AS act, 'p' || (k % 4) AS program,
      CASE WHEN k % 5 = 3 AND k % 2 = 0 THEN 'destructive' WHEN k % 5 = 1 THEN 'workspace' ELSE 'none' END AS effect,
      CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, 'f' || (k % 7) AS path, 't' || (k % 20) AS text
      FROM st WHERE event_type IN ('click', 'purchase', 'error'))"""
_TURNS = _TRACE + """,
    tn AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY step) - 1 AS "index", step AS "start",
      coalesce(lead(step) OVER (PARTITION BY key ORDER BY step) - 1, last) AS "end"
      FROM (SELECT *, max(step) OVER (PARTITION BY key) AS last FROM st) WHERE event_type = 'view'),
    ts_ AS (SELECT t.key, t."index", t."start", t."end", count(*) FILTER (WHERE s.kind = 'notice') AS notices, count(*) AS steps,
      count(*) FILTER (WHERE s.kind = 'tool_call') AS calls,
      CASE WHEN count(*) > 1 THEN (epoch_us(arg_max(s.ts, s.step)) - epoch_us(arg_min(s.ts, s.step))) / 1e6 END AS duration_s,
      max(CASE WHEN s.kind = 'notice' THEN s.step END) AS cut
      FROM tn t JOIN st s ON s.key = t.key AND s.step BETWEEN t."start" AND t."end" GROUP BY ALL),
    ta AS (SELECT t.key, t."index", count(*) AS actions, count(*) FILTER (WHERE a.act = 'edit') AS edits, count(*) FILTER (WHERE a.act = 'test') AS verifications,
      count(*) FILTER (WHERE a.act = 'ask') AS asks, count(*) FILTER (WHERE a.effect = 'destructive') AS side_effects,
      count(*) FILTER (WHERE a.outcome = 'error') AS failed_calls, arg_min(a.act, a.call) AS first_act, arg_max(a.act, a.call) AS last_act, max(a.call) AS last_call
      FROM tn t JOIN act a ON a.key = t.key AND a.call BETWEEN t."start" AND t."end" GROUP BY ALL),
    turns AS (SELECT s.key, s."index", s."start", s."end", s.notices, s.steps, s.calls, coalesce(a.actions, 0) AS actions, coalesce(a.edits, 0) AS edits,
      coalesce(a.verifications, 0) AS verifications, coalesce(a.asks, 0) AS asks, coalesce(a.side_effects, 0) AS side_effects,
      coalesce(a.failed_calls, 0) AS failed_calls, s.duration_s,
      CASE WHEN s.cut > coalesce(a.last_call, s."start") THEN 'interrupt' WHEN a.last_act = 'ask' THEN 'ask' ELSE 'tool' END AS ended_by, a.first_act, a.last_act
      FROM ts_ s LEFT JOIN ta a ON a.key = s.key AND a."index" = s."index")"""
_RETRY = _TRACE + """,
    ex AS (SELECT *, lag(position) OVER w AS before, lag(outcome = 'error') OVER w AS before_failed FROM act
      WINDOW w AS (PARTITION BY key, act, program, path, text, tool ORDER BY position)),
    bp AS (SELECT *, lag(position) OVER w AS last, lag(outcome = 'error') OVER w AS last_failed FROM ex WHERE act <> 'ask'
      WINDOW w AS (PARTITION BY key, act, path ORDER BY position)),
    rel AS (SELECT key, CASE WHEN before_failed THEN 'retry' ELSE 'repeat' END AS kind, position AS later, before AS earlier FROM ex WHERE before IS NOT NULL AND act <> 'ask'
      UNION ALL SELECT key, 'retry', position, last FROM bp WHERE before IS NULL AND last_failed)"""
_SEEN = _TRACE + """,
    pt AS (SELECT *, max(CASE WHEN act = 'read' THEN position END) OVER w AS seen, max(CASE WHEN act = 'edit' THEN position END) OVER w AS edited FROM act
      WINDOW w AS (PARTITION BY key, path ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_VERIFY = """ed AS (SELECT a.key, a.position, a.turn, lead(position) OVER (PARTITION BY key, path ORDER BY position) AS again FROM act a WHERE act = 'edit'),
    vf AS (SELECT e.key, 'verify' AS kind, min(t.position) AS later, e.position AS earlier, e.again FROM ed e
      JOIN act t ON t.key = e.key AND t.turn = e.turn AND t.act = 'test' AND t.position > e.position GROUP BY e.key, e.position, e.again
      HAVING e.again IS NULL OR min(t.position) < e.again)"""
_RECOVERED = """rc AS (SELECT a.key, a.position, a.call, min(b.position) AS recovered_position, min(b.call) AS recovered_at FROM act a
      LEFT JOIN act b ON b.key = a.key AND b.act = a.act AND b.path = a.path AND b.outcome = 'ok' AND b.position > a.position GROUP BY ALL)"""
_RUNS = """isl AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY position) AS island FROM act),
    nth AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY position) AS nth FROM isl),
    fr AS (SELECT n.key, 'failure_run' AS rule, n.call AS step, (SELECT min(a.call) FROM act a WHERE a.key = n.key AND a.position > n.position AND a.outcome = 'ok') AS recovered_at
      FROM nth n WHERE n.nth = 3 AND n.outcome = 'error')"""
_UNASKED = """mk AS (SELECT *, last_value(CASE WHEN act = 'ask' THEN 0 WHEN effect = 'destructive' THEN 1 END IGNORE NULLS) OVER
      (PARTITION BY key, turn ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM act),
    ua AS (SELECT key, 'side_effect_unasked' AS rule, call AS step FROM mk WHERE effect = 'destructive' AND last = 1)"""
_FOLLOW = """cq AS (SELECT key, "index", calls, lead("start") OVER (PARTITION BY key ORDER BY "index") AS next_start, ended_by FROM turns),
    fo AS (SELECT c.key, c."index", c.calls, CASE WHEN c.next_start IS NOT NULL THEN (f.key IS NOT NULL) OR c.ended_by = 'interrupt' END AS followed
      FROM cq c LEFT JOIN (SELECT DISTINCT key, step FROM fr) f ON f.key = c.key AND f.step = c.next_start)"""
_PATHS = """pa AS (SELECT o_custkey AS key, l_returnflag AS a, l_linestatus AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    px AS (SELECT key, '' AS node, 0 AS depth, '' AS parent FROM pa UNION ALL SELECT key, a, 1, '' FROM pa UNION ALL SELECT key, a || '/' || b, 2, a FROM pa)"""
_CUT = _PATHS + """,
    sup AS (SELECT node, depth, count(DISTINCT key) AS support FROM px GROUP BY ALL),
    lim AS (SELECT greatest(1, ceil(0.99 * count(DISTINCT key))) AS least FROM pa),
    cu AS (SELECT pa.key, CASE WHEN s2.support >= least THEN 2 WHEN s1.support >= least THEN 1 ELSE 0 END AS depth, pa.a, pa.b FROM pa
      JOIN sup s1 ON s1.node = pa.a AND s1.depth = 1 JOIN sup s2 ON s2.node = pa.a || '/' || pa.b AND s2.depth = 2 CROSS JOIN lim)"""

ORACLE: dict[str, str] = {
    "p1_steps_running_turn": f"""WITH {_CHAT} SELECT key, step, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY step) AS BIGINT) AS turn,
        CAST(length(content) AS BIGINT) AS chars, CASE WHEN length(content) > 100 THEN left(content, 100) || ' [... ' || (length(content) - 100) || ' more characters]' ELSE content END AS content FROM steps""",
    "p2_trajectories": f"WITH {_CHAT} SELECT key, count(*) AS steps, count(*) FILTER (WHERE role = 'user') AS turns FROM steps GROUP BY key",
    "w1_turn_cut": f"""WITH {_CHAT} SELECT key, row_number() OVER (PARTITION BY key ORDER BY step) - 1 AS "index", step AS "start",
        coalesce(lead(step) OVER (PARTITION BY key ORDER BY step) - 1, last) AS "end" FROM (SELECT *, max(step) OVER (PARTITION BY key) AS last FROM steps) WHERE role = 'user'""",
    "w2_step_windows": f"""WITH {_TRACE}, n AS (SELECT key, count(*) AS n FROM tr GROUP BY key), s AS (SELECT key, n, unnest(CASE WHEN n <= 40 THEN [0::BIGINT]
        ELSE list_distinct(list_concat(range(0, n - 40 + 1, 20), [n - 40])) END) AS "start" FROM n) SELECT key, "start", least("start" + 40, n) - 1 AS "end" FROM s""",
    "w3_greedy_chunks": f"""WITH RECURSIVE {_CHAT}, o AS (SELECT key, step, length(content) AS c, row_number() OVER (PARTITION BY key ORDER BY step) AS r FROM steps),
        g AS (SELECT key, step, r, c AS size, 0 AS chunk FROM o WHERE r = 1 UNION ALL
          SELECT o.key, o.step, o.r, CASE WHEN g.size > 0 AND g.size + o.c > 1500 THEN o.c ELSE g.size + o.c END, CASE WHEN g.size > 0 AND g.size + o.c > 1500 THEN g.chunk + 1 ELSE g.chunk END
          FROM g JOIN o ON o.key = g.key AND o.r = g.r + 1) SELECT key, step, CAST(chunk AS BIGINT) AS chunk FROM g""",
    "w4_last_request": f"WITH {_CHAT} SELECT key, step, max(CASE WHEN role = 'user' THEN step END) OVER (PARTITION BY key ORDER BY step) AS request FROM steps",
    "w5_context_before": f"""WITH {_CHAT}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step) AS r FROM steps)
        SELECT m.key, m.step AS message, s.step FROM o m JOIN o s ON s.key = m.key AND s.r BETWEEN m.r - 2 AND m.r - 1 WHERE m.role = 'user'""",
    "w7_action_moves": f"""WITH {_TRACE} SELECT key, position AS at, CASE WHEN turn <> coalesce(lag(turn) OVER w, 0) THEN 'prompt' WHEN lag(act) OVER w IS NULL THEN 'start'
        ELSE lag(act) OVER w || ':' || lag(outcome) OVER w END AS after, act FROM act WINDOW w AS (PARTITION BY key ORDER BY position)""",
    "w8_interjections": f"WITH {_TRACE} SELECT key, step FROM (SELECT key, step, kind, lag(kind) OVER (PARTITION BY key ORDER BY step) AS lk FROM st WHERE kind <> 'notice') WHERE kind = 'message' AND lk = 'tool_call'",
    "k5_rendered": f"""WITH {_CHAT}, r AS (SELECT key, string_agg('## ' || step || ' ' || role || ' message' || chr(10) || chr(10) ||
        CASE WHEN length(content) > 4000 THEN left(content, 4000) || ' [... ' || (length(content) - 4000) || ' more characters]' ELSE content END, chr(10) || chr(10) ORDER BY step) AS m FROM steps GROUP BY key)
        SELECT key, CAST(length(m) AS BIGINT) AS chars, sha256(m) AS sha256 FROM r""",
    "t6_turns": f"""WITH {_CHAT}, u AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY step) - 1 AS "index", step AS "start", CAST(length(content) AS BIGINT) AS prompt_chars,
        coalesce(lead(step) OVER (PARTITION BY key ORDER BY step) - 1, last) AS "end" FROM (SELECT *, max(step) OVER (PARTITION BY key) AS last FROM steps) WHERE role = 'user')
        SELECT u.key, u."index", u."start", u."end", u.prompt_chars, count(*) AS steps, count(*) FILTER (WHERE s.role = 'assistant') AS messages,
        CASE WHEN arg_max(s.role, s.step) = 'assistant' THEN 'response' ELSE 'tool' END AS ended_by
        FROM u JOIN steps s ON s.key = u.key AND s.step BETWEEN u."start" AND u."end" GROUP BY ALL""",
    "t6_trace_turns": f"WITH {_TURNS} SELECT * EXCLUDE (duration_s), round(duration_s, 3) AS duration_s FROM turns",
    "a5_oversight": f"""WITH {_TURNS} SELECT CAST(key AS BIGINT) % 5 AS batch, count(*) AS turns, round(avg(CASE WHEN ended_by = 'ask' THEN 1.0::DOUBLE ELSE 0 END), 3) AS ask_share,
        round(avg(CASE WHEN ended_by = 'interrupt' THEN 1.0::DOUBLE ELSE 0 END), 3) AS interrupt_share, round(quantile_cont(duration_s::DOUBLE, 0.5), 3) AS duration_p50,
        round(quantile_cont(duration_s::DOUBLE, 0.99), 3) AS duration_p99, round(avg(calls), 3) AS calls_per_turn FROM turns GROUP BY 1""",
    "a26_turn_stats": f"""WITH {_TURNS} SELECT key, count(*) AS turns, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(failed_calls) AS BIGINT) AS failed_calls, count(*) FILTER (WHERE ended_by = 'interrupt') AS ended_interrupt,
        count(*) FILTER (WHERE ended_by = 'ask') AS ended_ask, count(*) FILTER (WHERE ended_by = 'response') AS ended_response, count(*) FILTER (WHERE ended_by = 'tool') AS ended_tool FROM turns GROUP BY key""",
    "x1_basic": f"""WITH {_TRACE} SELECT key, count(*) AS n_steps, count(*) FILTER (WHERE kind = 'message') AS n_user_turns, CAST(sum(length(event_type || ' ' || k)) AS BIGINT) AS total_chars,
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 60, 4) AS duration_minutes FROM st GROUP BY key""",
    "x2_tool_usage": f"""WITH {_TRACE} SELECT key, count(*) AS n_tool_calls, round(count(*) FILTER (WHERE outcome = 'error') / count(*)::DOUBLE, 6) AS tool_error_rate, count(*) FILTER (WHERE tool = 'tool0') AS calls_tool0,
        count(*) FILTER (WHERE tool = 'tool1') AS calls_tool1, count(*) FILTER (WHERE tool = 'tool2') AS calls_tool2 FROM act GROUP BY key""",
    "x3_tool_paths": f"WITH {_TRACE} SELECT key, tool, outcome, count(*) AS n FROM act GROUP BY ALL",
    "x4_dialogue": f"""WITH {_CHAT}, p AS (SELECT *, row_number() OVER (PARTITION BY key, trim(content) ORDER BY step) AS nth, row_number() OVER (PARTITION BY key ORDER BY step) AS r FROM steps WHERE role = 'user')
        SELECT key, count(*) FILTER (WHERE nth > 1) AS repeated_prompts, round(avg(CASE WHEN r > 1 THEN (CASE WHEN length(content) <= 20 THEN 1.0 ELSE 0.0 END)::DOUBLE END), 6) AS short_prompt_share,
        quantile_cont(length(content)::DOUBLE, 0.5) AS prompt_chars_median FROM p GROUP BY key""",
    "x7_action_features": f"""WITH {_RETRY}, pt AS (SELECT *, max(CASE WHEN act = 'edit' THEN position END) OVER (PARTITION BY key, path ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edited FROM act), {_VERIFY},
        fe AS (SELECT *, min(CASE WHEN act = 'edit' THEN position END) OVER (PARTITION BY key) AS first_edit, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY position) AS island FROM act),
        lr AS (SELECT key, max(run) AS run FROM (SELECT key, island, count(*) AS run FROM fe WHERE outcome = 'error' GROUP BY ALL) GROUP BY key),
        c AS (SELECT key, count(DISTINCT CASE WHEN act = 'edit' THEN path END) AS edited_files, count(DISTINCT CASE WHEN act = 'read' THEN path END) AS observed_files, count(*) FILTER (WHERE act = 'edit') AS n_edits,
          count(*) FILTER (WHERE outcome = 'error') AS n_failed, max(CASE WHEN act = 'test' THEN position END) > max(CASE WHEN act = 'edit' THEN position END) AS late,
          avg(CASE WHEN act = 'test' THEN (CASE WHEN outcome = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE END) AS vfs, avg((CASE WHEN outcome = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE) AS cfs,
          count(*) FILTER (WHERE effect = 'destructive') AS side_effects, avg(CASE WHEN position < first_edit THEN (CASE WHEN act = 'read' THEN 1.0 ELSE 0.0 END)::DOUBLE END) AS ex FROM fe GROUP BY key)
        SELECT c.key, CAST(edited_files AS INT) AS edited_files, CAST(observed_files AS INT) AS observed_files,
          round(CASE WHEN n_edits > 0 THEN (SELECT count(DISTINCT position) FROM pt WHERE pt.key = c.key AND act = 'edit' AND edited IS NOT NULL) / n_edits::DOUBLE END, 6) AS reedit_share,
          round(CASE WHEN n_edits > 0 THEN (SELECT count(DISTINCT earlier) FROM vf WHERE vf.key = c.key) / n_edits::DOUBLE END, 6) AS edit_verified_share,
          CASE WHEN n_edits > 0 THEN coalesce(late, FALSE) END AS verified_at_end, round(vfs, 6) AS verification_failure_share, round(cfs, 6) AS call_failure_share,
          round(CASE WHEN n_failed > 0 THEN (SELECT count(DISTINCT earlier) FROM rel WHERE rel.key = c.key AND kind = 'retry') / n_failed::DOUBLE END, 6) AS retry_share,
          coalesce(lr.run, 0) AS longest_failure_run, side_effects, round(ex, 6) AS explore_share, 1.0::DOUBLE AS shell_commands_per_call FROM c LEFT JOIN lr ON lr.key = c.key""",
    "x9_seen_share": f"""WITH {_SEEN}, f AS (SELECT key, path, min(position) AS later FROM act WHERE act = 'edit' GROUP BY ALL)
        SELECT f.key, round(avg(CASE WHEN p.seen IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS edit_seen_share FROM f JOIN pt p ON p.key = f.key AND p.position = f.later GROUP BY f.key""",
    "x17_recovery_share": f"""WITH {_TRACE}, f AS (SELECT key, path, min(position) AS position, arg_min(act, position) AS act FROM act WHERE outcome = 'error' GROUP BY key, path)
        SELECT f.key, round(avg(CASE WHEN EXISTS (SELECT 1 FROM act a WHERE a.key = f.key AND a.path = f.path AND a.act = f.act AND a.position > f.position AND a.outcome = 'ok') THEN 1.0::DOUBLE ELSE 0 END), 6) AS recovery_share FROM f GROUP BY f.key""",
    "w9_repeat": f"WITH {_RETRY} SELECT * FROM rel WHERE kind = 'repeat'",
    "w10_retry": f"WITH {_RETRY} SELECT * FROM rel WHERE kind = 'retry'",
    "w11_seen": f"WITH {_SEEN} SELECT key, 'seen' AS kind, position AS later, seen AS earlier FROM pt WHERE act = 'edit' AND seen IS NOT NULL",
    "w12_reedit": f"WITH {_SEEN} SELECT key, 'reedit' AS kind, position AS later, edited AS earlier FROM pt WHERE act = 'edit' AND edited IS NOT NULL",
    "w14_verify": f"WITH {_TRACE}, {_VERIFY} SELECT key, kind, later, earlier FROM vf",
    "w16_recovery": f"WITH {_TRACE}, {_RECOVERED} SELECT r.key, r.position, recovered_position FROM rc r JOIN act a ON a.key = r.key AND a.position = r.position WHERE a.outcome = 'error'",
    "e2_blind_retry": f"""WITH {_RETRY}, {_RECOVERED} SELECT DISTINCT a.key, 'blind_retry' AS rule, a.call AS step, rc.recovered_at IS NOT NULL AS recovered, rc.recovered_at FROM rel
        JOIN act a ON a.key = rel.key AND a.position = rel.later JOIN act b ON b.key = rel.key AND b.position = rel.earlier JOIN rc ON rc.key = a.key AND rc.position = a.position
        WHERE rel.kind = 'retry' AND a.text = b.text AND a.path = b.path""",
    "e3_unasked": f"WITH {_TRACE}, {_UNASKED} SELECT * FROM ua",
    "e4_failure_run": f"WITH {_TRACE}, {_RUNS} SELECT key, rule, step, recovered_at IS NOT NULL AS recovered, recovered_at FROM fr",
    "e5_interrupted": f"""WITH {_TURNS} SELECT key, 'interrupted_at_plan' AS rule, "start" AS step FROM turns WHERE ended_by = 'interrupt' AND last_act IN ('plan', 'ask')
        UNION ALL SELECT key, 'interrupted_without_output', "start" FROM turns WHERE ended_by = 'interrupt' AND edits = 0 AND verifications = 0""",
    "j4_event_in_turn": f"""WITH {_TURNS}, {_RUNS} SELECT f.key, f.rule, f.step, t."index" FROM fr f LEFT JOIN tn t ON t.key = f.key AND f.step BETWEEN t."start" AND t."end" """,
    "a1_profile": """SELECT o_orderstatus, count(*) AS n, count(o_totalprice) AS present, count(DISTINCT o_totalprice) AS distinct_values, count(*) FILTER (WHERE o_totalprice = 0) AS zeros, min(o_totalprice) AS lowest,
        max(o_totalprice) AS highest, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1""",
    "a2_histogram": """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 40 AS w FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 39) AS BIGINT) AS bin, lo, w FROM orders, e)
        SELECT bin, round(bin * w + lo, 4) AS "start", count(*) AS n FROM b GROUP BY bin, lo, w""",
    "a6_spread": """WITH c AS (SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank, sum(n) OVER () AS t FROM c)
        SELECT value, n, round(n / t::DOUBLE, 6) AS share, rank FROM r WHERE rank <= 8""",
    "a7_explained": """WITH c AS (SELECT o_orderpriority AS g, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS v FROM orders), m AS (SELECT v, avg(v) OVER (PARTITION BY g) AS m FROM c)
        SELECT round(var_pop(m) / var_pop(v), 6) AS explained FROM m""",
    "a8_shift_effect": """WITH b AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders), x AS (SELECT b.o_orderstatus, b.o_orderpriority, o.o_totalprice AS v, o.o_orderpriority = b.o_orderpriority AS own FROM b JOIN orders o ON o.o_orderstatus = b.o_orderstatus),
        s AS (SELECT o_orderstatus, o_orderpriority, count(*) FILTER (WHERE own) AS n, count(*) FILTER (WHERE NOT own) AS n_baseline, avg(v) FILTER (WHERE own) AS m, avg(v) FILTER (WHERE NOT own) AS mb,
          var_pop(v) FILTER (WHERE own) AS va, var_pop(v) FILTER (WHERE NOT own) AS vb FROM x GROUP BY 1, 2)
        SELECT o_orderpriority, o_orderstatus, 'o_totalprice' AS "column", round((m - mb) / sqrt((va + vb) / 2), 4) AS effect, n, n_baseline FROM s WHERE n >= 30 AND n_baseline >= 30""",
    "n3_ks": """WITH c AS (SELECT o_orderstatus, o_totalprice AS x, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS b FROM orders GROUP BY 1, 2),
        g AS (SELECT o_orderstatus, abs(sum(a) OVER u / (sum(a) OVER t)::DOUBLE - sum(b) OVER u / (sum(b) OVER t)::DOUBLE) AS gap FROM c WINDOW u AS (PARTITION BY o_orderstatus ORDER BY x), t AS (PARTITION BY o_orderstatus))
        SELECT o_orderstatus, round(max(gap), 6) AS ks FROM g GROUP BY 1""",
    "w18_consequences": f"""WITH {_TURNS}, {_RUNS}, {_FOLLOW} SELECT key, "index", followed FROM fo""",
    "a13_lift": f"""WITH {_TURNS}, {_RUNS}, {_UNASKED}, {_FOLLOW}, ev AS (SELECT key, rule, step FROM fr UNION ALL SELECT key, rule, step FROM ua),
        lo AS (SELECT e.rule, t.key, t."index" FROM ev e JOIN tn t ON t.key = e.key AND e.step BETWEEN t."start" AND t."end"),
        kn AS (SELECT *, CAST(key AS BIGINT) % 2 AS stratum FROM fo WHERE followed IS NOT NULL), ba AS (SELECT stratum, avg(CASE WHEN followed THEN 1.0::DOUBLE ELSE 0 END) AS base FROM kn WHERE calls > 0 GROUP BY 1),
        h AS (SELECT lo.rule, CASE WHEN kn.followed THEN 1.0::DOUBLE ELSE 0 END AS f, ba.base FROM lo JOIN kn ON kn.key = lo.key AND kn."index" = lo."index" JOIN ba ON ba.stratum = kn.stratum)
        SELECT rule, count(*) AS hits, round(avg(f), 6) AS followed, round(avg(base), 6) AS baseline, round(avg(f) / nullif(avg(base), 0), 6) AS lift FROM h GROUP BY rule""",
    "a14_jaccard_noise": """WITH s AS (SELECT user_id AS key, list_distinct(list(event_type) FILTER (WHERE value < 50)) AS x, list_distinct(list(event_type) FILTER (WHERE value >= 50)) AS y FROM events GROUP BY 1),
        c AS (SELECT key, coalesce(x, []) AS x, coalesce(y, []) AS y FROM s), n AS (SELECT key, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM c)
        SELECT key, round(CASE WHEN u = 0 THEN 0.0 ELSE 1 - i / u::DOUBLE END, 6) AS noise FROM n""",
    "a23_confusion": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "a23_kappa": """WITH t AS (SELECT count(*) AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END)::DOUBLE AS same, sum(quality)::DOUBLE AS q, sum(toxic)::DOUBLE AS x FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
        p AS (SELECT n, same / n AS po, (q * x + (n - q) * (n - x)) / (n::DOUBLE * n) AS pe FROM t) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM p""",
    "j9_knn": """WITH d AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(distance, 9), neighbour) AS rank FROM d) SELECT key, neighbour, round(distance, 5) AS distance, rank FROM r WHERE rank <= 10""",
    "n7_outlier": """WITH d AS (SELECT a.vec_id AS key, a.label AS stratum, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance, b.vec_id AS o FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(distance, 9), o) AS rank FROM d), m AS (SELECT key, stratum, avg(distance) AS m FROM r WHERE rank <= 10 GROUP BY 1, 2),
        q AS (SELECT stratum, quantile_cont(m, 0.5) AS med FROM m GROUP BY 1) SELECT m.key, m.stratum, round(m.m / q.med, 5) AS outlier FROM m JOIN q ON q.stratum = m.stratum""",
    "n8_anomaly_rank": f"""WITH {_TRACE}, {_RUNS}, {_UNASKED}, lf AS (SELECT rule, lift FROM (@LIFT)),
        un AS (SELECT key, rule FROM fr WHERE recovered_at IS NULL UNION ALL SELECT key, rule FROM ua),
        op AS (SELECT key, greatest(coalesce(lift - 1, 1.0), 0.0)::DOUBLE AS w FROM un LEFT JOIN lf ON lf.rule = un.rule),
        sc AS (SELECT key, ln(1 + sum(w)) AS s FROM op GROUP BY key), k AS (SELECT key, count(*) % 7 / 10.0::DOUBLE AS o FROM tr GROUP BY key),
        j AS (SELECT k.key, coalesce(s, 0.0) AS events_score, o + coalesce(s, 0.0) AS anomaly_score FROM k LEFT JOIN sc ON sc.key = k.key)
        SELECT key, round(events_score, 6) AS events_score, round(anomaly_score, 6) AS anomaly_score, row_number() OVER (ORDER BY round(anomaly_score, 9) DESC, key) AS rank FROM j""",
    "n1_quartile_batches": """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
        SELECT CASE WHEN o_totalprice <= a THEN 'q1' WHEN o_totalprice <= b THEN 'q2' WHEN o_totalprice <= c THEN 'q3' ELSE 'q4' END AS batch, o_orderstatus AS stratum, count(*) AS n FROM orders, q GROUP BY 1, 2""",
    "n17_surprisal": """WITH c AS (SELECT lang, count(*) AS c FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY 1), t AS (SELECT sum(c) AS n, count(*) AS k FROM c)
        SELECT doc_id AS key, round(-ln((coalesce(c, 0) + 1) / (n + k + 1)::DOUBLE), 6) AS surprisal FROM documents d LEFT JOIN c ON c.lang = d.lang CROSS JOIN t""",
    "n21_drift": """WITH e AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS p), q AS (SELECT DISTINCT x FROM (SELECT (SELECT quantile_cont(o_totalprice, 0.0) FROM orders WHERE o_orderstatus = 'F') AS x
        """ + "".join(f" UNION ALL SELECT quantile_cont(o_totalprice, {i / 10}) FROM orders WHERE o_orderstatus = 'F'" for i in range(1, 11)) + """)),
        b AS (SELECT o.o_orderkey, o.o_orderstatus = 'F' AS own, count(*) FILTER (WHERE q.x < o.o_totalprice) + count(*) FILTER (WHERE q.x <= o.o_totalprice) AS bin FROM orders o, q GROUP BY 1, 2),
        c AS (SELECT bin, count(*) FILTER (WHERE own) AS a, count(*) FILTER (WHERE NOT own) AS b FROM b GROUP BY 1),
        p AS (SELECT a / (sum(a) OVER ())::DOUBLE AS p, b / (sum(b) OVER ())::DOUBLE AS q FROM c)
        SELECT round((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS divergence FROM p""",
    "n25_spearman": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 20""",
    "v9_tree_support": f"WITH {_PATHS} SELECT node, CAST(depth AS BIGINT) AS depth, count(DISTINCT key) AS support, count(*) AS events FROM px GROUP BY node, depth",
    "v10_cut_shares": f"""WITH {_CUT}, n AS (SELECT key, CASE depth WHEN 2 THEN a || ' | ' || b WHEN 1 THEN a || ' | *' ELSE '*' END AS label, count(*) AS n FROM cu GROUP BY 1, 2)
        SELECT key, label, round(n / (sum(n) OVER (PARTITION BY key))::DOUBLE, 6) AS share FROM n""",
    "v12_rare_share": f"WITH {_CUT} SELECT key, round(avg(CASE WHEN depth < 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rare_share, count(*) AS events FROM cu GROUP BY key",
    "a17_level_entropy": f"""WITH {_PATHS}, c AS (SELECT depth, node, count(*) AS n FROM px GROUP BY 1, 2), p AS (SELECT depth, n / (sum(n) OVER (PARTITION BY depth))::DOUBLE AS p FROM c),
        h AS (SELECT depth, sum(-p * log2(p)) AS h FROM p GROUP BY 1) SELECT CAST(depth AS BIGINT) AS depth, round(h - coalesce(lag(h) OVER (ORDER BY depth), 0), 6) AS bits FROM h QUALIFY depth > 0""",
    "n20_level_surprisal": f"""WITH {_PATHS}, r AS (SELECT * FROM px WHERE key % 2 = 0), c AS (SELECT node, depth, count(*) AS c FROM r GROUP BY 1, 2), k AS (SELECT parent, depth - 1 AS depth, count(DISTINCT node) AS k FROM r WHERE depth > 0 GROUP BY 1, 2),
        e AS (SELECT key, count(*) AS e FROM pa GROUP BY 1), s AS (SELECT x.key, x.depth, sum(-ln((coalesce(c.c, 0) + 1) / (coalesce(p.c, 0) + coalesce(k.k, 0) + 1)::DOUBLE)) AS t FROM px x
          LEFT JOIN c ON c.node = x.node AND c.depth = x.depth LEFT JOIN c p ON p.node = x.parent AND p.depth = x.depth - 1 LEFT JOIN k ON k.parent = x.parent AND k.depth = x.depth - 1 WHERE x.depth > 0 GROUP BY 1, 2)
        SELECT s.key, CAST(s.depth AS BIGINT) AS depth, round(t / e, 6) AS surprisal FROM s JOIN e ON e.key = s.key""",
    "v3_onehot": "SELECT doc_id, " + ", ".join(f"CASE WHEN lang IS NOT NULL THEN CASE WHEN lang = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS lang__{x}" for x in ("de", "en", "es", "fr")) + " FROM documents",
    "v4_multihot": "SELECT user_id AS key, " + ", ".join(f"CASE WHEN bool_or(value > 90 AND event_type = '{x}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kinds__{x}" for x in ("click", "error", "purchase", "signup", "view")) + ", count(DISTINCT CASE WHEN value > 90 THEN event_type END)::DOUBLE AS kinds__count FROM events GROUP BY 1",
    "v5_map_columns": f"WITH {_TRACE} SELECT key, " + ", ".join(f"count(*) FILTER (WHERE tool = 'tool{i}' AND outcome = 'error')::DOUBLE AS tool_errors__tool{i}" for i in range(3)) + " FROM act GROUP BY key",
    "v6_vector_aggs": """WITH e AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT key, round(list_max(v), 5) AS embedding__max, round(list_min(v), 5) AS embedding__min, round(list_avg(v), 5) AS embedding__mean,
        round(v[1], 5) AS embedding__first, round(v[-1], 5) AS embedding__last, """ + ", ".join(f"round(v[1 + CAST(floor({i} * (len(v) - 1) / 4.0) AS INT)] + (v[1 + CAST(ceil({i} * (len(v) - 1) / 4.0) AS INT)] - v[1 + CAST(floor({i} * (len(v) - 1) / 4.0) AS INT)]) * ({i} * (len(v) - 1) / 4.0::DOUBLE - floor({i} * (len(v) - 1) / 4.0)), 5) AS t{i}" for i in range(5)) + " FROM e",
    "v8_first_unrecovered": f"""WITH {_TRACE}, {_RUNS}, {_UNASKED}, op AS (SELECT key, rule, step FROM fr WHERE recovered_at IS NULL UNION ALL SELECT key, rule, step FROM ua),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step, rule) AS r FROM op) SELECT key, step, rule FROM r WHERE r = 1""",
    "v15_scaling": """WITH c AS (SELECT c_custkey AS key, c_acctbal AS b, CASE WHEN c_nationkey < 20 THEN c_nationkey::DOUBLE END AS n FROM customer),
        s AS (SELECT avg(b) AS mb, stddev_pop(b) AS sb, avg(n) AS mn, stddev_pop(n) AS sn, avg(CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS g FROM c)
        SELECT key, round((b - mb) / sb, 5) AS c_acctbal, round(coalesce((n - mn) / sn, 0) / sqrt(1 - g + g * (1 - g)), 5) AS nation, round(CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END / sqrt(1 - g + g * (1 - g)), 5) AS nation__missing FROM c, s""",
    "j1_features_view": f"""WITH {_TRACE}, f AS (SELECT key, path, min(position) AS position, arg_min(act, position) AS act FROM act WHERE outcome = 'error' GROUP BY key, path),
        q AS (SELECT f.key, avg(CASE WHEN EXISTS (SELECT 1 FROM act a WHERE a.key = f.key AND a.path = f.path AND a.act = f.act AND a.position > f.position AND a.outcome = 'ok') THEN 1.0::DOUBLE ELSE 0 END) AS r FROM f GROUP BY f.key),
        b AS (SELECT key, count(*) AS n_steps, CAST(sum(length(event_type || ' ' || k)) AS BIGINT) AS total_chars FROM st GROUP BY key)
        SELECT b.key, n_steps, total_chars, round(q.r, 6) AS recovery_share FROM b LEFT JOIN q ON q.key = b.key""",
}

_JUDGED = """j AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS "index", CASE WHEN length(text) % 3 = 0 THEN 'pushback' WHEN length(text) % 3 = 1 THEN 'approval' ELSE 'neutral' END AS value
    FROM conversations WHERE role = 'user')"""
_LONG = """lg AS (SELECT user_id AS key, event_type AS feature, max(value) AS value, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events GROUP BY 1, 2)"""

ORACLE |= {
    "j10_semi": "SELECT o_orderkey, o_custkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)",
    "j11_anti": "SELECT c_custkey AS key, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "p10_exists_filters": """SELECT c_custkey AS key, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
        OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 350000)""",
    "u5_multiset_diff": """SELECT user_id, event_type, count(*) FILTER (WHERE value < 60) - count(*) FILTER (WHERE value >= 60) AS n FROM events GROUP BY 1, 2
        HAVING count(*) FILTER (WHERE value < 60) > count(*) FILTER (WHERE value >= 60)""",
    "u6_symdiff": """WITH c AS (SELECT user_id, event_type, count(*) FILTER (WHERE value < 50) - count(*) FILTER (WHERE value >= 50) AS x FROM events GROUP BY 1, 2)
        SELECT user_id, event_type, CASE WHEN x > 0 THEN 'left' ELSE 'right' END AS side, abs(x) AS n FROM c WHERE x <> 0""",
    "o1_paged_sort": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 150",
    "o3_topk_columns": """WITH l AS (SELECT p_partkey AS key, p_size - 25.0::DOUBLE AS size, (p_retailprice - 1000) / 40.0::DOUBLE AS price, p_partkey % 31 - 15.0::DOUBLE AS place FROM part),
        u AS (SELECT key, 'size' AS n, abs(size) AS s FROM l UNION ALL SELECT key, 'price', abs(price) FROM l UNION ALL SELECT key, 'place', abs(place) FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, n) AS r FROM u) SELECT key, max(CASE WHEN r = 1 THEN n END) AS "first", max(CASE WHEN r = 2 THEN n END) AS "second" FROM r GROUP BY key""",
    "p9_search_filter": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND contains(lower(lang), 'en')",
    "w20_first_n": f"""WITH {_TRACE}, {_RUNS}, {_UNASKED}, ev AS (SELECT key, rule, step FROM fr UNION ALL SELECT key, rule, step FROM ua), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step, rule) AS r FROM ev)
        SELECT key, rule, step FROM r WHERE r <= 6""",
    "w21_last_judgment": f"""WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "index" DESC) AS r FROM j) SELECT key, 'reaction' AS feature, "index", value FROM r WHERE r = 1""",
    "a10_unit_aggregates": f"""WITH {_JUDGED} SELECT key, round(avg(CASE WHEN value = 'pushback' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, bool_or(value = 'approval') AS "any", count(*) FILTER (WHERE value = 'neutral') AS count,
        arg_min(value, "index") AS "first", arg_max(value, "index") AS "last" FROM j GROUP BY key""",
    "e7_judged_events": f"""WITH {_JUDGED} SELECT key, 'reaction' AS rule, "index" AS step FROM j WHERE value = 'pushback'""",
    "a12_latest_verdict_precision": """WITH l AS (SELECT event_type AS feature, user_id, arg_max(value > 40, event_id) AS worth FROM events GROUP BY 1, 2)
        SELECT feature, count(*) AS verdicts, round(avg(CASE WHEN worth THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision FROM l GROUP BY 1""",
    "h9_probe_ledger": """WITH h AS (SELECT DISTINCT event_type AS probe, user_id AS key FROM events WHERE value > 97), a AS (SELECT *, count(*) OVER (PARTITION BY key) = 1 AS alone FROM h),
        r AS (SELECT user_id AS key, count(*) % 2 = 0 AS found FROM events GROUP BY 1 HAVING user_id % 3 <> 0)
        SELECT probe, count(*) AS hits, count(found) AS read, count(*) FILTER (WHERE found) AS found, round(avg(CASE WHEN found THEN 1.0::DOUBLE WHEN NOT found THEN 0.0::DOUBLE END), 6) AS precision,
        count(*) FILTER (WHERE alone) AS exclusive FROM a LEFT JOIN r ON r.key = a.key GROUP BY probe""",
    "f28_apportion": """WITH w AS (SELECT source, count(*) AS w FROM documents GROUP BY 1), e AS (SELECT *, w * 37 / (sum(w) OVER ())::DOUBLE AS x FROM w), b AS (SELECT *, CAST(least(floor(x), w) AS BIGINT) AS f, x - floor(x) AS r FROM e),
        p AS (SELECT *, row_number() OVER (ORDER BY r DESC, source) AS p, 37 - sum(f) OVER () AS lft FROM b) SELECT source, w, CAST(least(f + CASE WHEN p <= lft THEN 1 ELSE 0 END, w) AS BIGINT) AS share FROM p""",
    "k1_replace_by_key": """WITH u AS (SELECT o_custkey AS key, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_custkey, 'N' FROM orders WHERE o_custkey % 6 = 0)
        SELECT o_orderstatus, count(*) AS n, count(DISTINCT key) AS keys FROM u GROUP BY 1""",
    "k2_feature_rows": f"""WITH {_LONG} SELECT key, max(CASE WHEN feature = 'click' AND status = 'ok' THEN value END) AS click, max(CASE WHEN feature = 'click' THEN status END) AS click__status,
        max(CASE WHEN feature = 'error' AND status = 'ok' THEN value END) AS error, max(CASE WHEN feature = 'error' THEN status END) AS error__status FROM lg GROUP BY key""",
    "a11_coverage": f"WITH {_LONG} SELECT feature, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed FROM lg GROUP BY 1",
    "r3_label_expansion": f"WITH {_TRACE} SELECT key, tool AS label, count(*)::DOUBLE AS value FROM act WHERE outcome = 'error' GROUP BY 1, 2",
    "r6_group_compare": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1",
    "r9_course": f"""WITH {_TURNS}, {_RUNS} SELECT t.key, t."index", count(f.step) AS marks FROM tn t LEFT JOIN fr f ON f.key = t.key AND f.step BETWEEN t."start" AND t."end" GROUP BY 1, 2""",
    "a25_typical": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM c)
        SELECT o_orderstatus, o_orderpriority AS typical FROM r WHERE r = 1""",
    "n18_tail_counts": "WITH v AS (SELECT DISTINCT o_totalprice AS x FROM orders), c AS (SELECT v.x, count(f.o_totalprice) AS n FROM v LEFT JOIN orders f ON f.o_orderstatus = 'F' AND f.o_totalprice >= v.x GROUP BY 1) SELECT o_orderkey AS key, n AS at_least FROM orders JOIN c ON c.x = o_totalprice",
    "n24_median_labels": "WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) SELECT CASE WHEN o_totalprice > m THEN 'failure' ELSE 'other' END AS label, count(*) AS n FROM orders, m GROUP BY 1",
    "q_sql_bridge": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1",
    "q_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "z_hourly_windows": """SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS "start", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""",
    "z_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "k12_restricted": """SELECT CAST(conv_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS steps, CAST(NULL AS VARCHAR) AS secret FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1""",
}

ORACLE["n8_anomaly_rank"] = ORACLE["n8_anomaly_rank"].replace("@LIFT", ORACLE["a13_lift"])
