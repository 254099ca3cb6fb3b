"""Queries over calls and sessions, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from ..functions.regexes import spread
from ..operators import audit, behavior, chain, ordered
from ..policy import columns, model
from ..sources import adapters
from ..sources.adapters import with_adapters
from ..sources.log import latest_catalog, spans, with_annotations

CUT = 1704067200000 + 10 * 86_400_000  # ten days into the log
NOW = 1704067200000 + 20 * 86_400_000
PRICES = [("app__p*", 0.5), ("app__view|app__click", 0.01), ("app__pur*", 9.0), ("x*|app__error", 0.25)]
PER_MILLION = 2.0
FWD = "(decision = 'allow' OR shadow)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a function of (calls, sessions) as a query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(adapters.calls(spark, d), adapters.sessions(spark, d))
        if sql:
            ORACLES[f.__name__] = sql if raw else with_adapters(sql)
        return f

    return add


@query("""SELECT s.*, CAST(coalesce(n.calls, 0) AS BIGINT) AS calls, CAST(coalesce(n.denied, 0) AS BIGINT) AS denied FROM sessions s
LEFT JOIN (SELECT session_id, count(*) AS calls, count(*) FILTER (decision = 'deny') AS denied FROM calls GROUP BY 1) n ON n.session_id = s.id
ORDER BY started_ms DESC, id DESC LIMIT 200""")
def sessions_list(c, s):
    return audit.session_list(s, c)


@query("SELECT * FROM sessions WHERE id LIKE 'u14%' AND (id = 'u14' OR NOT EXISTS (SELECT 1 FROM sessions WHERE id = 'u14')) ORDER BY id LIMIT 2")
def session_prefix(c, s):
    return audit.session_by_prefix(s, "u14")


CALL = "id, session_id, ts_ms, tool, decision, rule_id, shadow, duration_ms, seq"
COLS = CALL.split(", ")


@query(f"SELECT {CALL} FROM calls WHERE decision = 'deny' AND lower(tool) LIKE '%view%' AND ts_ms >= {CUT} ORDER BY ts_ms, id LIMIT 5000")
def calls_filtered(c, s):
    return audit.call_filter(c, decision="deny", tool="VIEW", since_ms=CUT).select(COLS)


@query(f"SELECT {CALL} FROM calls ORDER BY ts_ms DESC, id DESC LIMIT 100")
def calls_newest(c, s):
    return audit.call_filter(c, newest=True, limit=100).select(COLS)


@query(f"SELECT {CALL} FROM calls WHERE seq > 500 AND rule_id = 'canary' ORDER BY seq LIMIT 1000")
def calls_after_seq(c, s):
    return audit.call_filter(c, rule="canary", after_seq=500, limit=1000).select(COLS)


@query("SELECT id, session_id, tool, decision FROM calls WHERE id = '000000000042'")
def call_by_id(c, s):
    return c.where("id = '000000000042'").select("id", "session_id", "tool", "decision")


@query(f"SELECT ts_ms, tool, tokens_est, session_id FROM calls WHERE ts_ms >= {CUT} AND {FWD}")
def forwarded_calls(c, s):
    return audit.forwarded(c, CUT)


@query(f"""SELECT count(*) AS calls, count(*) FILTER (decision = 'deny' AND NOT shadow) AS denied, count(*) FILTER (shadow) AS shadowed,
count(*) FILTER (rule_id = 'honeypot') AS honeypot, count(*) FILTER (rule_id = 'canary') AS canary, count(*) FILTER (rule_id = 'quarantine') AS quarantine,
count(*) FILTER (is_error AND decision = 'allow') AS errors, CAST(coalesce(sum(tokens_est), 0) AS BIGINT) AS tokens,
(SELECT count(*) FROM sessions WHERE started_ms >= {CUT}) AS sessions FROM calls WHERE ts_ms >= {CUT}""")
def global_stats(c, s):
    return audit.global_stats(s, c, CUT)


@query(f"""SELECT tool, max(upstream) AS upstream, count(*) AS calls, count(*) FILTER {FWD} AS allowed, count(*) FILTER (decision = 'deny' AND NOT shadow) AS denied,
count(*) FILTER (decision = 'ask') AS asked, count(*) FILTER (is_error) AS errors, round(avg(duration_ms) FILTER (decision = 'allow'), 6) AS avg_ms,
CAST(sum(tokens_est) AS BIGINT) AS tokens, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM calls GROUP BY tool ORDER BY calls DESC, tool""")
def tool_stats(c, s):
    return audit.tool_stats(c)


@query("SELECT rule_id, decision, count(*) AS n FROM calls WHERE rule_id <> '' GROUP BY 1, 2")
def rule_stats(c, s):
    return audit.rule_stats(c)


@query("SELECT label, session_id, count(*) OVER (PARTITION BY label) AS n_sessions FROM (SELECT DISTINCT unnest(labels) AS label, session_id FROM calls)")
def labels_sessions(c, s):
    return audit.label_sessions(c)


@query("SELECT id, CASE WHEN shadow THEN 'shadow' WHEN decision = 'deny' THEN 'deny' WHEN is_error THEN 'error' ELSE 'allow' END AS class FROM calls")
def decision_class(c, s):
    return audit.decision_class(c)


@query("""SELECT id, CASE WHEN rule_id = 'honeypot' THEN 'TRAP' WHEN rule_id = 'canary' THEN 'CANARY' WHEN rule_id = 'quarantine' THEN 'HELD' WHEN shadow THEN 'SHADOW'
WHEN decision = 'deny' THEN 'DENY' WHEN decision = 'ask' THEN 'ASK' WHEN is_error THEN 'ERROR' ELSE 'allow' END AS badge FROM calls""")
def tail_badges(c, s):
    return audit.tail_badges(c)


@query("""SELECT condition, CAST(value AS BIGINT) AS value FROM (
SELECT 'canary > 0' AS condition, count(*) FILTER (rule_id = 'canary') AS value, 0 AS n FROM calls HAVING count(*) FILTER (rule_id = 'canary') > 0 UNION ALL
SELECT 'denied >= 3', count(*) FILTER (decision = 'deny' AND NOT shadow), 0 FROM calls HAVING count(*) FILTER (decision = 'deny' AND NOT shadow) >= 3 UNION ALL
SELECT 'rule:no-clicks > 2', count(*) FILTER (rule_id = 'no-clicks'), 0 FROM calls HAVING count(*) FILTER (rule_id = 'no-clicks') > 2 UNION ALL
SELECT 'calls < 100', count(*), 0 FROM calls HAVING count(*) < 100)""")
def thresholds_crossed(c, s):
    return audit.crossed(audit.global_stats(s, c), audit.rule_stats(c), "canary>0, denied>=3, rule:no-clicks>2, calls<100")


LAST = f"(SELECT coalesce(min(seq) FILTER (ts_ms >= {CUT}) - 1, max(seq)) FROM calls)"


@query(f"SELECT id, seq FROM calls WHERE NOT seq <= {LAST}")
def retention_calls(c, s):
    return audit.retain_calls(c, CUT).select("id", "seq")


@query(f"SELECT id, started_ms FROM sessions s WHERE NOT (coalesce(ended_ms, started_ms) < {CUT} AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.session_id = s.id AND NOT c.seq <= {LAST}))")
def retention_sessions(c, s):
    return audit.retain_sessions(s, audit.retain_calls(c, CUT), CUT).select("id", "started_ms")


@query(f"SELECT {LAST} AS last_seq")
def retention_anchor(c, s):
    return audit.retention_last(c, CUT)


@query(f"""SELECT hash, created_ms FROM (SELECT 'c' || ts_ms // 86400000 AS hash, min(ts_ms) AS created_ms FROM calls GROUP BY 1) WHERE NOT (created_ms < {CUT}
AND hash NOT IN (SELECT 'c' || ts_ms // 86400000 FROM calls WHERE NOT seq <= {LAST}) AND hash NOT IN (SELECT 'c' || started_ms // 86400000 FROM sessions WHERE id IN ('u3', 'u5', 'u8')))""")
def retention_catalogs(c, s):
    """A catalog a day; a few sessions and all calls that stay were made under theirs."""
    day = lambda t: F.concat(F.lit("c"), F.floor(F.col(t) / 86_400_000).cast("string")).alias("catalog_hash")
    kept = s.where("id IN ('u3', 'u5', 'u8')").select(day("started_ms"))
    return audit.retain_catalogs(_catalogs(c), kept, audit.retain_calls(c, CUT).select(day("ts_ms")), CUT).select("hash", "created_ms")


@query("SELECT c.id, c.session_id FROM calls c WHERE c.session_id NOT IN (SELECT id FROM sessions WHERE host_name <> 'BUILDING')")
def orphan_calls(c, s):
    return audit.orphan_calls(c, s.where("host_name <> 'BUILDING'")).select("id", "session_id")


COST = f"CASE WHEN starts_with(tool, 'app__p') THEN 0.5 WHEN tool IN ('app__view', 'app__click') THEN 0.01 WHEN tool = 'app__error' THEN 0.25 ELSE 0 END + tokens_est * {PER_MILLION} / 1e6"


@query(f"""SELECT CASE GROUPING(day, tool) WHEN 1 THEN 'day' WHEN 2 THEN 'tool' ELSE 'total' END AS grouping, coalesce(day, '') AS day, coalesce(tool, '') AS tool, count(*) AS calls, CAST(sum(tokens_est) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost
FROM (SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, CASE tool WHEN 'app__signup' THEN '' ELSE tool END AS tool, tokens_est, {COST} AS cost FROM calls WHERE ts_ms >= 1704067200000 AND ts_ms < {NOW} AND {FWD})
GROUP BY GROUPING SETS ((day), (tool), ())""")
def bill_grouping_sets(c, s):
    """Price patterns are tried in name order: app__p* settles what app__pur* would; one tool has no name."""
    return audit.bill(c.withColumn("tool", F.when(F.col("tool") == "app__signup", "").otherwise(F.col("tool"))), PRICES, PER_MILLION, 1704067200000, NOW)


@query(f"""SELECT id, round(sum(CAST(CASE WHEN tool IN ('app__click', 'app__view') THEN 0.01 ELSE 0.5 END AS DOUBLE)) OVER (PARTITION BY floor(ts_ms / 86400000) ORDER BY ts_ms, id), 6) AS spent FROM calls WHERE {FWD}""")
def daily_ledger(c, s):
    return ordered.daily_ledger(c, F.when(F.col("tool").isin("app__click", "app__view"), 0.01).otherwise(0.5))


@query("""SELECT s.id, started_ms, shadowed, denied, allowed, asked, errors, tokens, coalesce(labels, '') AS labels, first_seq, last_seq, greatest(started_ms, coalesce(ended_ms, started_ms), last_ms) AS end_ms FROM sessions s
JOIN (SELECT session_id, count(*) FILTER (shadow) AS shadowed, count(*) FILTER (decision = 'deny' AND NOT shadow) AS denied, count(*) FILTER (decision = 'allow') AS allowed,
count(*) FILTER (reason LIKE '%approved by%' OR reason LIKE '%rejected by%') AS asked, count(*) FILTER (is_error) AS errors, CAST(sum(tokens_est) AS BIGINT) AS tokens,
min(seq) AS first_seq, max(seq) AS last_seq, max(ts_ms + duration_ms) AS last_ms FROM calls GROUP BY 1) n ON n.session_id = s.id
LEFT JOIN (SELECT session_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT session_id, unnest(labels) AS label FROM calls) GROUP BY 1) l ON l.session_id = s.id""")
def report_sessions(c, s):
    return audit.session_report(s, c)


@query("SELECT session_id, tool, count(*) AS calls, count(*) FILTER (decision = 'deny' AND NOT shadow) AS denied, count(*) FILTER (is_error) AS errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM calls GROUP BY 1, 2")
def report_tools(c, s):
    return audit.session_tools(c)


@query("""SELECT id, round(CASE WHEN b > a THEN least(greatest((ts_ms - a) / CAST(b - a AS DOUBLE) * 1000, 0), 1000) ELSE 0 END, 6) AS x,
format('+{:02d}:{:02d}:{:02d}', (ts_ms - a) // 3600000, (ts_ms - a) // 60000 % 60, (ts_ms - a) // 1000 % 60) AS "offset"
FROM calls JOIN (SELECT session_id AS sid, min(ts_ms) AS a, max(ts_ms + duration_ms) AS b FROM calls GROUP BY 1) ON sid = session_id""")
def timeline_marks(c, s):
    return audit.timeline(s, c)


@query("""SELECT tool, calls, CASE WHEN trap THEN 'honeypot' WHEN allowed > 0 THEN 'allow' ELSE 'deny' END AS action,
CAST(CASE WHEN 2 * most <= 10 THEN 10 WHEN 2 * most <= 100 THEN ceil(2 * most / 10.0) * 10 ELSE ceil(2 * most / 100.0) * 100 END AS BIGINT) AS calls_per_session
FROM (SELECT tool, count(*) AS calls, count(*) FILTER (decision = 'allow' OR shadow) AS allowed, bool_or(rule_id = 'honeypot') AS trap FROM calls GROUP BY 1),
(SELECT max(n) AS most FROM (SELECT count(*) AS n FROM calls GROUP BY session_id))""")
def suggest_policy(c, s):
    return audit.suggest(c)


@query("""SELECT id, row_number() OVER (PARTITION BY session_id, island ORDER BY ts_ms, id) - 1 AS streak
FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS island
FROM (SELECT *, CASE WHEN tool = lag(tool) OVER (PARTITION BY session_id ORDER BY ts_ms, id) THEN 0 ELSE 1 END AS fresh FROM calls))""")
def loop_streaks(c, s):
    return ordered.loop_streaks(c, F.col("tool"))


@query(f"""SELECT a.id, count(b.id) AS rate FROM calls a LEFT JOIN (SELECT * FROM calls WHERE {FWD}) b ON b.session_id = a.session_id AND b.ts_ms > a.ts_ms - 21600000
AND (b.ts_ms < a.ts_ms OR (b.ts_ms = a.ts_ms AND b.id < a.id)) GROUP BY a.id""")
def trailing_rate(c, s):
    return ordered.trailing_rate(c, 6 * 3_600_000)


W = "(PARTITION BY session_id ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""SELECT id, CAST(coalesce(sum(went) OVER {W}, 0) AS BIGINT) AS session_calls,
CAST(coalesce(sum(went) OVER (PARTITION BY session_id, tool ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tool_calls,
CAST(coalesce(sum(went * tokens_est) OVER {W}, 0) AS BIGINT) AS tokens FROM (SELECT *, CASE WHEN {FWD} THEN 1 ELSE 0 END AS went FROM calls)""")
def running_counters(c, s):
    return ordered.running_counters(c)


@query("SELECT session_id, label, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY ts_ms, id) AS n FROM (SELECT session_id, id, ts_ms, unnest(labels) AS label FROM calls)) WHERE n = 1")
def first_earned_labels(c, s):
    return ordered.first_labels(c)


@query("""SELECT a.id, coalesce((SELECT string_agg(DISTINCT b.tool, ',' ORDER BY b.tool) FROM calls b WHERE b.session_id = a.session_id AND (b.ts_ms < a.ts_ms OR (b.ts_ms = a.ts_ms AND b.id < a.id))), '') AS called FROM calls a""")
def called_so_far(c, s):
    return ordered.called_so_far(c)


@query("""SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT a.id, b.label FROM calls a JOIN (SELECT session_id, ts_ms, unnest(labels) AS label FROM calls) b
ON b.session_id <> a.session_id AND b.ts_ms < a.ts_ms AND b.ts_ms >= a.ts_ms - 1800000) GROUP BY id""")
def shared_labels(c, s):
    return ordered.shared_labels(c)


@query("""SELECT q.request_id, q.tool, q.args_hash, r.result_json FROM
(SELECT id AS request_id, tool, args_hash, row_number() OVER (PARTITION BY tool, args_hash ORDER BY id) AS n FROM calls WHERE seq % 2 = 1) q LEFT JOIN
(SELECT tool, args_hash, decision || ':' || id AS result_json, row_number() OVER (PARTITION BY tool, args_hash ORDER BY ts_ms, id) AS n, count(*) OVER (PARTITION BY tool, args_hash) AS most FROM calls WHERE seq % 2 = 0) r
ON r.tool = q.tool AND r.args_hash = q.args_hash AND (r.n = q.n OR (r.n = r.most AND q.n > r.most))""")
def mock_answers(c, s):
    r = c.where("seq % 2 = 0").withColumn("result_json", F.concat_ws(":", "decision", "id"))
    return ordered.mock_answers(r, c.where("seq % 2 = 1").select(F.col("id").alias("request_id"), "tool", "args_hash"))


@query(f"""SELECT tool, count(*) AS hour, count(*) FILTER (ts_ms > {NOW} - 60000) AS minute FROM calls WHERE ts_ms > {NOW} - 3600000 AND ts_ms <= {NOW} GROUP BY tool ORDER BY hour DESC, tool LIMIT 8""")
def top_frame(c, s):
    return ordered.top_frame(c, NOW)


@query("""SELECT substr(sha256('tracewell:session:' || session_id), 1, 32) AS trace_id, substr(sha256('tracewell:call:' || id), 1, 16) AS span_id, tool AS name, ts_ms * 1000000 AS start_ns, (ts_ms + duration_ms) * 1000000 AS end_ns,
CASE WHEN decision = 'deny' AND NOT shadow THEN 'denied' WHEN is_error THEN 'error' ELSE 'ok' END AS status FROM calls""")
def spans_otlp(c, s):
    return spans(c)


def _q(v: str, q: str) -> str:
    return f"max({v}) FILTER ({v}_i = least(n - 1, CAST(floor(n * {q}) AS BIGINT)))"


PROFILE = f"""SELECT tool, count(*) AS calls, round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_rate, max(ts_ms) AS to_ms,
{_q('result_bytes', '0.5')} AS result_bytes_p50, {_q('result_bytes', '0.95')} AS result_bytes_p95, max(result_bytes) AS result_bytes_max,
{_q('duration_ms', '0.5')} AS duration_ms_p50, {_q('duration_ms', '0.95')} AS duration_ms_p95, max(duration_ms) AS duration_ms_max
FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY result_bytes) - 1 AS result_bytes_i, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS duration_ms_i, count(*) OVER (PARTITION BY tool) AS n
FROM calls WHERE {FWD} AND ts_ms < {CUT}) GROUP BY tool"""


@query(f"""WITH p AS ({PROFILE}) SELECT p.*, 'k' AS arg_keys, l.labels FROM p JOIN
(SELECT tool, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT tool, unnest(labels) AS label FROM calls WHERE {FWD} AND ts_ms < {CUT}) GROUP BY 1) l USING (tool)""")
def behavior_profile(c, s):
    p = behavior.profile(c.where(F.col("ts_ms") < CUT))
    return p.withColumn("arg_keys", F.array_join("arg_keys", ",")).withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH p AS ({PROFILE}), l AS (SELECT DISTINCT tool, unnest(labels) AS label FROM calls WHERE {FWD} AND ts_ms < {CUT}) SELECT c.id, 'new-argument' AS kind, 'extra' AS detail FROM calls c JOIN p USING (tool) WHERE c.ts_ms >= {CUT} AND p.calls >= 20 AND c.seq % 50 = 0
UNION ALL SELECT c.id, 'new-label', label FROM (SELECT id, tool, unnest(list_concat(labels, CASE WHEN seq % 70 = 0 THEN ['odd'] ELSE [] END)) AS label FROM calls WHERE ts_ms >= {CUT}) c JOIN p USING (tool) WHERE p.calls >= 20 AND NOT EXISTS (SELECT 1 FROM l WHERE l.tool = c.tool AND l.label = c.label)
UNION ALL SELECT c.id, 'result-size' AS kind, CAST(c.result_bytes AS VARCHAR) AS detail FROM calls c JOIN p USING (tool)
WHERE c.ts_ms >= {CUT} AND p.calls >= 20 AND c.result_bytes > greatest(1.5 * greatest(p.result_bytes_p95, 1), 4096, p.result_bytes_max)
UNION ALL SELECT c.id, 'slow', CAST(c.duration_ms AS VARCHAR) FROM calls c JOIN p USING (tool) WHERE c.ts_ms >= {CUT} AND p.calls >= 20 AND c.duration_ms > greatest(1.5 * greatest(p.duration_ms_p95, 1), 2000)""")
def behavior_anomalies(c, s):
    """Later calls, of which every fiftieth has an argument more and every seventieth a label more, against the profile of earlier ones."""
    late = c.where(F.col("ts_ms") >= CUT).withColumn("args_json", F.when(F.col("seq") % 50 == 0, F.regexp_replace("args_json", r"\}$", ',"extra":1}')).otherwise(F.col("args_json")))
    late = late.withColumn("labels", F.when(F.col("seq") % 70 == 0, F.array_append("labels", F.lit("odd"))).otherwise(F.col("labels")))
    return behavior.anomalies(late, behavior.profile(c.where(F.col("ts_ms") < CUT)), factor=1.5)


# --- the chain: a call's JSON text, links built by recursion, a verifier over neighbours -----------

_TEXTS = {"result_json": "", "result_hash": "", "error": "", "catalog_hash": ""}


def _json_sql(seq: str) -> str:
    def field(name: str) -> str:
        kind, _ = chain.CALL_COLUMNS[name]
        if name == "seq":
            return f"CAST({seq} AS VARCHAR)"
        if name in _TEXTS:
            return "'\"\"'"
        if name == "result_truncated":
            return "'false'"
        if name == "labels":
            return "CAST(to_json(array_to_string(labels, ',')) AS VARCHAR)"
        return f"CAST(to_json({name}) AS VARCHAR)" if kind.simpleString() == "string" else f"CAST({name} AS VARCHAR)"

    text = " || ',' || ".join(f"'\"{n}\":' || {field(n)}" for n in chain.LINKED)
    return rf"replace(replace(replace('{{' || {text} || '}}', '&', '\u0026'), '<', '\u003c'), '>', '\u003e')"


BUILT = f"""numbered AS MATERIALIZED (SELECT *, {_json_sql("n")} AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS n FROM calls)),
built AS (SELECT session_id, id, n, '' AS prev_hash, sha256(chr(10) || text) AS row_hash FROM numbered WHERE n = 1
UNION ALL SELECT t.session_id, t.id, t.n, b.row_hash, sha256(b.row_hash || chr(10) || t.text) FROM built b JOIN numbered t ON t.session_id = b.session_id AND t.n = b.n + 1)"""


def chained(sql: str) -> str:
    """A query over ``calls`` and ``built``, the calls' links."""
    return with_adapters(f"WITH {BUILT}{sql}").replace("WITH calls", "WITH RECURSIVE calls", 1)


@query(chained(" SELECT id, n AS seq, prev_hash, row_hash FROM built"), raw=True)
def chain_build(c, s):
    return chain.build(c).select("id", "seq", "prev_hash", "row_hash")


def _tampered(c):
    """Built calls of which some are dropped, some changed, some linked anew and some numbered anew."""
    n = F.col("id").cast("long")
    built = chain.build(c).where(n % 89 != 7)
    built = built.withColumn("reason", F.when(n % 97 == 5, "edited").otherwise(F.col("reason")))
    return built.withColumn("prev_hash", F.when(n % 101 == 3, "other").otherwise(F.col("prev_hash"))).withColumn("seq", F.when(n % 103 == 4, F.col("seq") - 1).otherwise(F.col("seq")))


_VERIFIED = f""", edited AS (SELECT c.* REPLACE (CASE WHEN k % 97 = 5 THEN 'edited' ELSE reason END AS reason), CASE WHEN k % 103 = 4 THEN n - 1 ELSE n END AS s, CASE WHEN k % 101 = 3 THEN 'other' ELSE prev_hash END AS prev, row_hash
  FROM (SELECT *, CAST(id AS BIGINT) AS k FROM calls) c JOIN built USING (session_id, id) WHERE k % 89 <> 7),
near AS (SELECT *, coalesce(lag(s) OVER w, 0) AS before, coalesce(lag(row_hash) OVER w, '') AS linked, {_json_sql("s")} AS text FROM edited WINDOW w AS (PARTITION BY session_id ORDER BY s, id)),
problems AS (SELECT session_id, id, s AS seq, problem FROM (SELECT *, unnest([CASE WHEN s <= before THEN 'order' END, CASE WHEN s > before + 1 THEN 'gap' END, CASE WHEN prev <> linked THEN 'link' END,
  CASE WHEN row_hash <> sha256(prev || chr(10) || text) THEN 'content' END]) AS problem FROM near) WHERE problem IS NOT NULL)"""


@query(chained(_VERIFIED + " SELECT * FROM problems"), raw=True)
def chain_verify(c, s):
    return chain.verify(_tampered(c))


@query(chained(_VERIFIED + """ SELECT e.session_id, checked, CAST(0 AS BIGINT) AS legacy, head_seq, head_hash, coalesce(problems, 0) AS problems FROM
(SELECT session_id, count(*) AS checked, max(s) AS head_seq FROM edited GROUP BY 1) e JOIN (SELECT session_id, max_by(row_hash, s) AS head_hash FROM edited GROUP BY 1) h USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS problems FROM problems GROUP BY 1) p USING (session_id)"""), raw=True)
def chain_report(c, s):
    return chain.verify_report(_tampered(c).where(F.col("id").cast("long") % 103 != 4))


ORACLES["chain_report"] = ORACLES["chain_report"].replace("WHERE k % 89 <> 7)", "WHERE k % 89 <> 7 AND k % 103 <> 4)")


@query(chained(" SELECT session_id, n AS seq, row_hash FROM built WHERE (session_id, n) IN (SELECT session_id, max(n) FROM built GROUP BY 1)"), raw=True)
def head_link(c, s):
    return chain.head_links(chain.build(c))


_ANCHORED = """, u AS (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS u FROM built), kept AS (SELECT * FROM u WHERE u % 7 <> 0 OR n >= 3),
a AS (SELECT session_id, n AS seq, CASE WHEN u % 2 = 0 THEN row_hash ELSE 'other' END AS hash FROM u WHERE n = 4 AND u % 21 <> 0
UNION ALL SELECT session_id, n, unnest([row_hash, 'x']) FROM u WHERE n = 5 AND u % 5 = 0 UNION ALL SELECT session_id, 10000000, 'y' FROM u WHERE n = 1 AND u % 6 = 1 UNION ALL SELECT session_id, 1, row_hash FROM u WHERE n = 1 AND u % 7 = 0),
e AS (SELECT session_id, min(n) AS lo, max(n) AS hi FROM kept GROUP BY 1),
j AS (SELECT a.session_id, a.seq, a.hash, count(*) OVER (PARTITION BY a.session_id, a.seq) AS same, count(*) OVER (PARTITION BY a.session_id) AS anchors, k.row_hash, lo, hi FROM a LEFT JOIN e USING (session_id) LEFT JOIN kept k ON k.session_id = a.session_id AND k.n = a.seq)
SELECT session_id, seq, hash, status, status NOT IN ('ok', 'pruned') OR (status = 'pruned' AND anchors = 1) AS problem FROM
(SELECT *, CASE WHEN same > 1 THEN 'contradiction' WHEN row_hash = hash THEN 'ok' WHEN seq < lo THEN 'pruned' WHEN seq > hi THEN 'beyond' ELSE 'conflict' END AS status FROM j)"""


@query(chained(_ANCHORED), raw=True)
def anchor_check(c, s):
    """Each session's chain with its anchors: right and wrong ones, two that differ, some beyond its end, some before what is kept of it."""
    built = chain.build(c).withColumn("u", F.substring("session_id", 2, 18).cast("long"))
    pick = lambda where, seq, h: built.where(where).select("session_id", seq.alias("seq"), h.alias("hash"))
    seq, own = F.col("seq"), F.col("row_hash")
    a = pick("seq = 4 AND u % 21 <> 0", seq, F.when(F.col("u") % 2 == 0, own).otherwise("other")).union(pick("seq = 5 AND u % 5 = 0", seq, F.explode(F.array(own, F.lit("x")))))
    a = a.union(pick("seq = 1 AND u % 6 = 1", F.lit(10000000).cast("long"), F.lit("y"))).union(pick("seq = 1 AND u % 7 = 0", seq, own))
    return chain.verify_anchors(built.where("u % 7 <> 0 OR seq >= 3"), a)


@query(chained(" SELECT id, n AS seq, prev_hash, row_hash FROM built WHERE n > 10"), raw=True)
def chain_append(c, s):
    """Chains of which the first ten links are stored go on from their heads: the links of one build."""
    first = chain.build(c)
    stored = first.where("seq <= 10")
    new = first.join(stored.select("id"), "id", "left_anti").select(c.columns)
    return chain.append(new, chain.head_links(stored)).select("id", "seq", "prev_hash", "row_hash")


# --- documents and catalogs ------------------------------------------------------------------------

NUMBER = "(args_json->>'$.k')"


@query(f"""SELECT id, '{{"k":' || {NUMBER} || '}}' AS args_json, sha256('{{"k":' || {NUMBER} || '}}') AS args_hash, CAST(floor((length({NUMBER}) + 6 + strlen(r)) / 4) AS BIGINT) AS tokens_est,
strlen(r) > 40 AS result_truncated, sha256(r) AS result_hash, CASE WHEN strlen(r) > 40 THEN '{{"_bytes":' || strlen(r) || ',"_truncated":true,"head":' || CAST(to_json(substr(r, 1, 40)) AS VARCHAR) || '}}' ELSE r END AS result_json
FROM (SELECT *, '{{"a":[1.0,"' || tool || '"],"b":{{"k":' || {NUMBER} || ',"ts":' || ts_ms || '}}}}' AS r FROM calls)""")
def prepared_calls(c, s):
    result = F.format_string(' { "b" : {"ts": %s, "k": %s},\n "a": [ 1.0, "%s" ] } ', F.col("ts_ms"), F.get_json_object("args_json", "$.k"), F.col("tool"))
    c = spread(c.select("id", "args_json", "ts_ms", "tool"))
    raw = c.select("id", "args_json", documents.canonical(result).alias("result_json"))
    return documents.prepare(raw, 40)


CATALOG = """[{"exposed":"app__view","tool":{"name":"view","annotations":{"readOnlyHint":true,"title":"View"}}},{"exposed":"app__purchase","tool":{"annotations":{"destructiveHint":true}}},
{"exposed":"app__error","tool":{"annotations":{"idempotentHint":true}}},{"exposed":"app__click","tool":{"name":"click"}},{"exposed":"app__signup","tool":{"annotations":{"destructiveHint":false,"openWorldHint":false}}}]"""


def _catalogs(c):
    """A catalog a day; every third day's says nothing of its tools."""
    day = F.floor(F.col("ts_ms") / 86_400_000)
    return c.groupBy(F.concat(F.lit("c"), day.cast("string")).alias("hash")).agg(F.min("ts_ms").alias("created_ms"), F.first(F.when(day % 3 == 0, "[]").otherwise(CATALOG)).alias("json"))


@query("SELECT 'c' || max(ts_ms // 86400000) AS hash, min(ts_ms) AS created_ms FROM calls WHERE ts_ms // 86400000 = (SELECT max(ts_ms // 86400000) FROM calls)")
def catalog_latest(c, s):
    return latest_catalog(_catalogs(c)).select("hash", "created_ms")


@query("""SELECT id, CASE WHEN d % 3 = 0 OR tool = 'app__click' THEN NULL WHEN tool = 'app__view' THEN true ELSE false END AS read_only,
CASE WHEN d % 3 = 0 OR tool = 'app__click' THEN NULL ELSE tool IN ('app__purchase', 'app__error') END AS destructive,
CASE WHEN d % 3 = 0 OR tool = 'app__click' THEN NULL ELSE tool <> 'app__signup' END AS open_world,
CASE WHEN d % 3 <> 0 AND tool IN ('app__purchase', 'app__error') THEN 'ask' ELSE 'allow' END AS action FROM (SELECT *, ts_ms // 86400000 AS d FROM calls)""")
def calls_annotated(c, s):
    """The catalog's annotations of each call's tool, and what the pack that asks before destructive tools says."""
    named = c.withColumn("catalog_hash", F.concat(F.lit("c"), F.floor(F.col("ts_ms") / 86_400_000).cast("string"))).withColumn("tool_name", F.regexp_replace("tool", "^app__", ""))
    judged = columns.evaluate(with_annotations(named, _catalogs(c)), model.load({"packs": ["ask-destructive"]}))
    return judged.select("id", "read_only", "destructive", "open_world", "verdict.action")


@query(f"""SELECT s.id, s.started_ms, CAST(coalesce(n, 0) AS BIGINT) AS calls, coalesce(labels, '') AS labels FROM (SELECT * FROM sessions WHERE started_ms >= {CUT} - 240 * 3600000 ORDER BY started_ms DESC, id DESC LIMIT 5000) s
LEFT JOIN (SELECT session_id, count(*) AS n FROM calls GROUP BY 1) c ON c.session_id = s.id
LEFT JOIN (SELECT session_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT session_id, unnest(labels) AS label FROM calls) GROUP BY 1) l ON l.session_id = s.id WHERE ended_ms IS NULL""")
def live_sessions(c, s):
    """Open sessions of the ten days up to ``CUT`` (here all start on the first)."""
    return audit.live_sessions(s, c, CUT, 5000, 240 * 3_600_000).withColumn("labels", F.array_join("labels", ","))
