"""Policies over the call log, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from ..operators import chain, decisions
from ..policy import cases, columns, model, offers, probes, session
from ..sources import adapters
from ..sources.adapters import with_adapters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STATELESS = model.load({
    "rules": [
        {"id": "no-big-views", "tool": "app.view", "when": {"args.k": {"gt": 90}}, "action": "deny"},
        {"id": "ask-range", "tool": "app__p*|app.signup", "when": {"args.k": {"gt": 10, "lt": 20}}, "action": "ask", "reason": "in the range"},
        {"id": "exact", "tool": "*", "when": {"args.k": [7, 8, 9]}, "action": "deny"},
        {"id": "late", "tool": "/err/", "when": {"time.hour": {"gt": 20}}, "action": "ask"},
    ],
})
BUDGET = model.load({"budget": {"calls_per_session": 20}})
LABELS = model.load({
    "labels": [{"label": "saw-error", "tool": "app.error"}, {"label": "big", "tool": "*", "when": {"args.k": {"gt": 95}}}],
    "rules": [{"id": "after-error", "tool": "app.purchase", "when": {"session.label.saw-error": True}, "action": "deny"}],
})


def calls_of(spark, d):
    """The log as policies look at it: the tool's own name beside the exposed one."""
    return adapters.calls(spark, d).withColumn("tool_name", F.regexp_replace("tool", "^app__", ""))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(calls_of(spark, d))
        if sql:
            ORACLES[f.__name__] = with_adapters(sql)
        return f

    return add


K = "CAST(json_extract_string(args_json, '$.k') AS BIGINT)"
HOUR = "(ts_ms // 3600000) % 24"
FIRST = f"CASE WHEN tool = 'app__view' AND {K} > 90 THEN 'no-big-views' WHEN (tool LIKE 'app__p%' OR tool = 'app__signup') AND {K} > 10 AND {K} < 20 THEN 'ask-range' WHEN {K} IN (7, 8, 9) THEN 'exact' WHEN tool LIKE '%err%' AND {HOUR} > 20 THEN 'late' ELSE '' END"


@query(f"""SELECT id, CASE rule_id WHEN '' THEN 'allow' WHEN 'ask-range' THEN 'ask' WHEN 'late' THEN 'ask' ELSE 'deny' END AS action, rule_id,
CASE rule_id WHEN '' THEN 'default allow' WHEN 'ask-range' THEN 'in the range' WHEN 'no-big-views' THEN 'matched rule no-big-views (app.view)' WHEN 'exact' THEN 'matched rule exact (*)' ELSE 'matched rule late (/err/)' END AS reason
FROM (SELECT id, {FIRST} AS rule_id FROM calls)""")
def policy_first_match(c):
    return columns.evaluate(c, STATELESS).select("id", "verdict.action", "verdict.rule_id", "verdict.reason")


@query(f"SELECT id, concat_ws(',', CASE WHEN tool = 'app__error' THEN 'saw-error' END, CASE WHEN {K} > 95 THEN 'big' END) AS labels FROM calls")
def policy_labels(c):
    return columns.prepared(c).select("id", F.array_join(columns.labels_earned(LABELS), ",").alias("labels"))


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) > 20 THEN 'deny' ELSE 'allow' END AS action FROM calls")
def replay_budget(c):
    return session.replay(c, BUDGET).select("id", "action")


@query("""SELECT id, CASE WHEN tool = 'app__purchase' AND coalesce(earned, 0) > 0 THEN 'deny' ELSE 'allow' END AS action
FROM (SELECT *, sum(CASE WHEN tool = 'app__error' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earned FROM calls)""")
def replay_labels(c):
    return session.replay(c, LABELS).select("id", "action")


@query("""SELECT count(*) FILTER (a = 'allow') AS allowed, count(*) FILTER (a <> 'allow') AS not_allowed, count(*) FILTER (a <> decision) AS changed FROM (SELECT decision, CASE WHEN tool = 'app__purchase' AND coalesce(earned, 0) > 0 THEN 'deny' ELSE 'allow' END AS a
FROM (SELECT *, sum(CASE WHEN tool = 'app__error' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earned FROM calls))""")
def replay_counts(c):
    return session.replay_counts(session.replay(c, LABELS))


def session_diff(spark, d):
    pairs = spark.createDataFrame([("a", "u1", "u2"), ("b", "u3", "u4"), ("c", "u5", "u5")], "pair string, a string, b string")
    return session.diff(calls_of(spark, d), pairs)


QUERIES["session_diff"] = session_diff


def _parts(spark, d, changed: bool):
    p = spark.read.parquet(f"{d}/part.parquet")
    kind = F.when(F.col("p_partkey") % 17 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")) if changed else F.col("p_type")
    p = p.where(F.col("p_partkey") % 19 != (0 if changed else 1))
    return p.select(F.col("p_brand").alias("upstream"), F.concat(F.lit("tool-"), F.col("p_partkey").cast("string")).alias("ref"), F.sha2(kind, 256).alias("hash"))


QUERIES["pin_check"] = lambda spark, d: chain.pin_check(_parts(spark, d, True), _parts(spark, d, False))
ORACLES["pin_check"] = """SELECT coalesce(o.b, p.b) AS upstream, coalesce(o.ref, p.ref) AS ref, CASE WHEN p.ref IS NULL THEN 'new' WHEN o.ref IS NULL THEN 'removed' WHEN o.h = p.h THEN 'pinned' ELSE 'changed' END AS status
FROM (SELECT p_brand AS b, 'tool-' || p_partkey AS ref, CASE WHEN p_partkey % 17 = 0 THEN p_type || '!' ELSE p_type END AS h FROM part WHERE p_partkey % 19 <> 0) o
FULL OUTER JOIN (SELECT p_brand AS b, 'tool-' || p_partkey AS ref, p_type AS h FROM part WHERE p_partkey % 19 <> 1) p ON o.b = p.b AND o.ref = p.ref"""
QUERIES["registry_compare"] = lambda spark, d: chain.registry_compare(_parts(spark, d, True), _parts(spark, d, False).drop("upstream"))
ORACLES["registry_compare"] = """SELECT coalesce(o.ref, p.ref) AS ref, CASE WHEN p.ref IS NULL THEN 'only-here' WHEN o.ref IS NULL THEN 'only-in-registry' WHEN o.h = p.h THEN 'same' ELSE 'differs' END AS status
FROM (SELECT 'tool-' || p_partkey AS ref, CASE WHEN p_partkey % 17 = 0 THEN p_type || '!' ELSE p_type END AS h FROM part WHERE p_partkey % 19 <> 0) o
FULL OUTER JOIN (SELECT 'tool-' || p_partkey AS ref, p_type AS h FROM part WHERE p_partkey % 19 <> 1) p ON o.ref = p.ref"""
QUERIES["registry_latest"] = lambda spark, d: chain.registry_latest(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").cast("string").alias("path"), F.sha2(F.col("o_orderpriority"), 256).alias("hash")))
ORACLES["registry_latest"] = "SELECT CAST(o_custkey AS VARCHAR) AS path, sha256(max_by(o_orderpriority, o_orderkey)) AS hash, count(*) AS published FROM orders GROUP BY o_custkey"
QUERIES["merkle_roots"] = lambda spark, d: chain.merkle_roots(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("skill"), F.concat_ws("/", F.lpad("l_orderkey", 12, "0"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_returnflag").alias("kind"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash")))


# --- registry log, definitions, folded decisions ----------------------------------------------------


def registry_verify(spark, d):
    """Orders are the log, customers the files: some records misplaced, some files changed, missing or never logged."""
    place = F.col("o_orderkey")
    log = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 13 <> 2").select(place.alias("place"), F.when(place % 97 == 5, place + 1).otherwise(place).alias("index"), F.col("o_custkey").cast("string").alias("path"), F.sha2("o_orderpriority", 256).alias("hash"))
    now = chain.registry_latest(log)
    files = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 11 <> 3").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey")
    files = files.join(now, "path", "left").select("path", F.when(F.col("c_custkey") % 7 == 1, F.sha2("path", 256)).otherwise(F.col("hash")).alias("hash"))
    return chain.registry_verify(log, files)


QUERIES["registry_verify"] = registry_verify
ORACLES["registry_verify"] = """WITH logged AS (SELECT * FROM orders WHERE o_custkey % 13 <> 2), here AS (SELECT * FROM customer WHERE c_custkey % 11 <> 3)
SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'moved' AS problem FROM logged WHERE o_orderkey % 97 = 5
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'gone' FROM logged WHERE o_custkey NOT IN (SELECT c_custkey FROM here)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey IN (SELECT o_custkey FROM logged) THEN 'changed' ELSE 'by-hand' END FROM here
WHERE c_custkey NOT IN (SELECT o_custkey FROM logged) OR c_custkey % 7 = 1"""


SIZES = (1, 2, 3, 700, 1024, 1500)


def registry_heads(spark, d):
    """Heads over the first records of a log whose lines are the orders, and over all, each frontier going on from the one before."""
    line = F.format_string('{"index":%s,"path":"p%s","hash":"%s"}', "o_orderkey", "o_custkey", "o_orderstatus")
    leaves = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("place"), F.sha2(F.concat(F.lit(b"\x00"), line.cast("binary")), 256).alias("leaf"))
    heads, out = [], []
    for size in sorted({*SIZES, leaves.count()}):
        heads = chain.frontier(leaves, size, heads)
        out.append((size, chain.frontier_root(heads)))
    return spark.createDataFrame(out, "size long, root string")


QUERIES["registry_heads"] = registry_heads
ORACLES["registry_heads"] = f"""WITH RECURSIVE leaves AS (SELECT o_orderkey AS place, sha256(unhex('00') || encode('{{"index":' || o_orderkey || ',"path":"p' || o_custkey || '","hash":"' || o_orderstatus || '"}}')) AS leaf FROM orders),
up AS (SELECT size, place, leaf, size AS n FROM leaves, (SELECT DISTINCT unnest(list_append({list(SIZES)}, (SELECT count(*) FROM orders))) AS size) WHERE place < size
UNION ALL SELECT size, place // 2, CASE WHEN place + 1 < n THEN sha256(unhex('01') || unhex(leaf) || unhex(right_leaf)) ELSE leaf END, (n + 1) // 2
FROM (SELECT *, lead(leaf) OVER (PARTITION BY size ORDER BY place) AS right_leaf FROM up WHERE n > 1) WHERE place % 2 = 0)
SELECT CAST(size AS BIGINT) AS size, leaf AS root FROM up WHERE n = 1"""


OFFERS = {"m1": ["Brand#1*", "Brand#2?", "!Brand#13", "!*25"], "m2": ["!Brand#4*"], "m3": ["Brand#99"]}


def offered_tools(spark, d):
    """Parts are tools: of each maker's brands which are offered."""
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string")).alias("upstream"), F.col("p_brand").alias("tool_name"))
    return t.where(offers.offered(OFFERS)).select("p_partkey", "upstream", "tool_name")


QUERIES["offered_tools"] = offered_tools
ORACLES["offered_tools"] = """SELECT p_partkey, 'm' || p_partkey % 5 AS upstream, p_brand AS tool_name FROM part WHERE CASE p_partkey % 5 WHEN 1 THEN (p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2_') AND p_brand <> 'Brand#13' AND p_brand NOT LIKE '%25'
WHEN 2 THEN p_brand NOT LIKE 'Brand#4%' WHEN 3 THEN p_brand = 'Brand#99' ELSE true END"""


def definition_hashes(spark, d):
    """A part is a tool, written with blanks, keys out of order and members that say nothing."""
    written = F.format_string('{ "title": "", "inputSchema": {"type":"object", "required":[%s]},  "name": "%s", "arguments": [], "annotations": {}, "vendor": 1, "description": "%s" }', F.col("p_size"), F.col("p_name"), F.col("p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", documents.definition_hash(written).alias("hash"))


QUERIES["definition_hashes"] = definition_hashes
ORACLES["definition_hashes"] = """SELECT p_partkey, 'sha256:' || sha256('{"description":"' || p_type || '","inputSchema":{"required":[' || p_size || '],"type":"object"},"name":"' || p_name || '"}') AS hash FROM part"""

#: A user is a request, its events are the answers to it.
ANSWERS = """SELECT CAST(user_id AS BIGINT) AS request, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 < 3 THEN 'chat' ELSE 'terminal' END AS channel,
CASE WHEN event_id % 5 < 2 THEN '' ELSE concat('p', CAST(event_id % 11 AS STRING)) END AS who, event_id % 53 <> 7 AS allow, event_id % 4 <> 0 AS for_session FROM {events}"""


def quorum_answers(spark, d):
    answers = spark.sql(ANSWERS, events=spark.read.parquet(f"{d}/events.parquet"))
    requests = answers.select("request").distinct().withColumn("quorum", F.col("request") % 9 + 1)
    return decisions.quorum(requests, answers)


QUERIES["quorum_answers"] = quorum_answers
ORACLES["quorum_answers"] = f"""WITH a AS (SELECT *, request % 9 + 1 AS quorum, CASE WHEN who = '' THEN '/' || channel ELSE who END AS person FROM ({ANSWERS.format(events="events")})),
said AS (SELECT *, min(CASE WHEN NOT allow THEN seq END) OVER (PARTITION BY request) AS denied_at, row_number() OVER (PARTITION BY request, person ORDER BY NOT allow, seq) AS nth FROM a WHERE channel <> ''),
first AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY seq) AS place FROM said WHERE allow AND nth = 1 AND (denied_at IS NULL OR seq < denied_at)),
folded AS (SELECT request, count(*) AS approvals, bool_and(for_session) AS together FROM first WHERE place <= quorum GROUP BY request)
SELECT request, CASE WHEN coalesce(approvals, 0) >= quorum THEN 'allow' ELSE 'deny' END AS action, coalesce(approvals, 0) AS approvals, coalesce(approvals >= quorum AND together, false) AS for_session
FROM (SELECT DISTINCT request, quorum FROM a) LEFT JOIN folded USING (request)"""


def input_requests(spark, d):
    """Events are requests to the host: a view asks the user for fields, others the host's model."""
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id") % 5
    schema = F.when(n == 0, '{"properties":{"zip":{"title":"Postal code"},"apiKey":{},"pin":{"title":"PIN"}}}').when(n == 1, '{"properties":{"word":{"format":"password"}}}').when(n == 2, '{"properties":{"pinned":{}}}').when(n == 3, "no schema")
    kind = F.when(F.col("event_type") == "view", "elicitation").otherwise("sampling")
    return decisions.input_requests(e.select(F.floor(F.col("event_id") / 3).alias("call_id"), F.col("event_id").alias("seq"), kind.alias("kind"), schema.alias("schema")), "ask", "deny")


QUERIES["input_requests"] = input_requests
ORACLES["input_requests"] = """SELECT call_id, action, action AS would, kind, credential FROM (SELECT event_id // 3 AS call_id, CASE WHEN event_type = 'view' THEN 'deny' ELSE 'ask' END AS action,
CASE WHEN event_type = 'view' THEN 'elicitation' ELSE 'sampling' END AS kind, CASE event_id % 5 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'word' END AS credential,
row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_type = 'view' DESC, event_id) AS nth FROM events) WHERE nth = 1"""


# --- probes of policies -----------------------------------------------------------------------------


@query(f"""SELECT id AS "case", expect, action, rule_id, action = expect AND (seq % 5 <> 0 OR rule_id = 'exact') AS passed FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'allow' ELSE 'deny' END AS expect,
CASE rule_id WHEN '' THEN 'allow' WHEN 'ask-range' THEN 'ask' WHEN 'late' THEN 'ask' ELSE 'deny' END AS action FROM (SELECT id, seq, {FIRST} AS rule_id FROM calls))""")
def policy_cases(c):
    """Every call is a case; what they expect is made up, so some pass and some fail."""
    each = c.drop("rule_id").withColumns({"case": F.col("id"), "expect": F.when(F.col("seq") % 2 == 0, "allow").otherwise("deny"), "expect_rule": F.when(F.col("seq") % 5 == 0, "exact")})
    return probes.check_cases(each, STATELESS)


@query(f"""SELECT id, session_id AS "case", action, rule_id, CAST(CASE WHEN action <> decision THEN 1 WHEN recorded <> '' AND recorded <> rule_id THEN 1 ELSE 0 END AS INTEGER) AS problems FROM
(SELECT id, 'session ' || session_id AS session_id, decision, rule_id AS recorded, CASE first WHEN '' THEN 'allow' WHEN 'ask-range' THEN 'ask' WHEN 'late' THEN 'ask' ELSE 'deny' END AS action, first AS rule_id
FROM (SELECT *, {FIRST} AS first FROM calls WHERE rule_id NOT IN ('honeypot', 'canary', 'quarantine', 'frozen')))""")
def recorded_cases(c):
    """Every recorded session as a case of a policy that did not make its decisions."""
    played, expected = cases.recorded(c)
    return cases.run_cases(played, expected, STATELESS).select("id", "case", "action", "rule_id", F.size("problems").alias("problems"))


SPELLED = model.load({
    "rules": [
        {"id": "open", "tool": "app.read", "when": {"args.path": {"path_prefix": "/srv/open"}}, "action": "allow"},
        {"id": "files", "tool": "app.view", "when": {"args.url": {"regex": "^https://files[.]example[.]net/"}}, "action": "deny"},
        {"id": "drop", "tool": "app.purchase", "when": {"args.sql": {"sql_regex": "(?i)^drop table"}}, "action": "deny"},
        {"id": "conf", "tool": "app.click", "when": {"args.path": {"prefix": "/etc/conf/"}}, "action": "deny"},
        {"id": "rm", "tool": "app.signup", "when": {"args.command": {"regex": "^rm -rf"}}, "action": "ask"},
    ],
})
SPELLED_ARGS = {"view": '{"url":"https://files.example.net/x/%s","n":1}', "purchase": '{"sql":"DROP TABLE t%s"}', "click": '{"path":"/etc/conf/%s.key"}', "signup": '{"command":"rm -rf /tmp/%s"}'}
#: What gets through: all spellings of the address and the command, as their rules look at the text's start only.
_FOUND = [
    *(("view", t, True) for t in ("host in capitals", "a trailing dot on the host", "an explicit default port", "user info before the host")),
    *(("purchase", t, t == "a harmless statement first") for t in ("lower-case SQL", "SQL keywords split by a newline", "SQL keywords split by a comment", "a comment line before the SQL", "leading whitespace", "a harmless statement first")),
    *(("click", t, t in ("a leading //", "an allowed directory, then .. back out")) for t in ("a ./ in the path", "a doubled slash", "a detour through ..", "a leading //", "an allowed directory, then .. back out")),
    *(("signup", t, True) for t in ("doubled spaces", "a tab for a space", "run through env", "run through command", "run through sh -c", "run through bash -c", "after another command", "on a second line", "the command quoted", "the command escaped", "an empty quote inside the command", "the command by its full path", "short flags split", "short flags swapped")),
]


@query(f"""SELECT 'app__' || e AS tool, technique, n AS spellings, CASE WHEN hole THEN n ELSE 0 END AS bypasses
FROM (VALUES {", ".join(f"('{e}', '{t}', {hole})" for e, t, hole in _FOUND)}) f (e, technique, hole) JOIN (SELECT tool, count(*) AS n FROM calls GROUP BY 1) c ON c.tool = 'app__' || e""")
def policy_fuzz(c):
    """Calls that read, drop, open and delete: which of their spellings the policy lets through."""
    args = F.lit("{}")
    for name, text in SPELLED_ARGS.items():
        args = F.when(F.col("tool_name") == name, F.format_string(text, F.col("seq"))).otherwise(args)
    found = probes.fuzz(c.withColumn("args_json", args), SPELLED)
    return found.groupBy("tool", "technique").agg(F.count("*").alias("spellings"), F.count_if("bypass").alias("bypasses"))
