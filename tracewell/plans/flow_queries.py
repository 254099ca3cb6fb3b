"""Where data goes, each query beside its DuckDB SQL: conversations are sessions, their turns are calls.

Assistants read (and what they read is planted with secret values), users send; what
they send is planted with values and passages read before, in other spellings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detect import flows, secrets

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def turns(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts_ms"), "conv_id", "role", "text")


_TURNS = "t AS (SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, turn AS ts_ms, conv_id, role, text FROM conversations)"


def _value(conv, at):
    """The secret that a turn of a conversation reads."""
    return F.substring(F.sha2(F.concat_ws(":", conv.cast("string"), at.cast("string")), 256), 1, 24)


@query(f"""WITH {_TURNS}, v AS (SELECT *, substr(sha256(conv_id || ':' || ts_ms), 1, 24) AS value FROM t WHERE role = 'assistant'),
s AS (SELECT *, (conv_id + ts_ms) % 6 AS how FROM t WHERE role = 'user')
SELECT s.id, v.value, v.id AS source, CASE how WHEN 1 THEN 'reversed' WHEN 2 THEN 'hex' WHEN 3 THEN 'base64' ELSE 'plain' END AS encoding
FROM s JOIN v ON v.session_id = s.session_id AND v.ts_ms = s.ts_ms - 1 WHERE how < 5""")
def tainted_calls(spark, d):
    """Values that assistants read and users send on in the next turn: plain, reversed, in hex, in base64, percent-encoded; every sixth sends another conversation's."""
    t = turns(spark, d)
    at, conv = F.col("ts_ms"), F.col("conv_id")
    read = t.where("role = 'assistant'").select("session_id", at.alias("at"), "id", F.concat("text", F.lit("\napi_key = "), _value(conv, at)).alias("text"))
    before, how = _value(conv, at - 1), (conv + at) % 6
    sent = F.when(how == 0, before).when(how == 1, F.reverse(before)).when(how == 2, F.hex(before.cast("binary"))).when(how == 3, F.base64(F.concat(F.lit("key "), before, F.lit("!")).cast("binary")))
    sent = sent.when(how == 4, F.regexp_replace(F.hex(before.cast("binary")), "(..)", "%$1")).otherwise(_value(conv + 1, at - 1))
    return flows.tainted_calls(read, t.where("role = 'user'").select("session_id", at.alias("at"), "id", F.concat("text", F.lit(" <"), sent, F.lit(">")).alias("text")))


CONTRACTS = flows.load_flows([
    {"id": "notes", "from": ["label:private"], "to": ["app__exec", "app__mail"], "action": "warn"},
    {"id": "records", "from": ["app.query"], "to": ["app.ex*"], "reason": "query results stay out of commands"},
    {"id": "none", "from": ["app.query"], "to": ["app.other"], "action": "ask"},
])
_TWO_64 = 1 << 64


#: Characters whose capitals are several, though one stands for them, and that one; others of the kind stay as they are.
_SEVERAL = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1 and (c == "ß" or len(c.title()) == 1)]
_ONE = ["ẞ" if c == "ß" else c.title() for c in _SEVERAL]


def capitals(text):
    """The text in capitals, a character for a character, as SQL has them."""
    one = lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.translate(c, "".join(_SEVERAL), "".join(_ONE)))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def prints_sql(source: str) -> str:
    """``source``: a table of (key, text) -> (key, print): winnowed fingerprints, as ``secrets.text_prints`` makes them, in 128-bit integers."""
    powers = [pow(0x100000001B3, secrets.K - 1 - j, _TWO_64) for j in range(secrets.K)]
    hashed = " + ".join(f"CAST({p} AS HUGEINT) * c[i + {j}]" for j, p in enumerate(powers))
    mixed, k = "xor(h, h >> 29)", 0xBF58476D1CE4E5B9
    times = f"((((({mixed}) >> 32) * {k}) % 4294967296) * 4294967296 + (({mixed}) & 4294967295) * {k}) % {_TWO_64}"
    return f"""(SELECT DISTINCT key, least AS print FROM (SELECT key, i, n, min(h) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND {secrets.W - 1} FOLLOWING) AS least
FROM (SELECT key, i, n, CASE WHEN h >= {_TWO_64 // 2} THEN h - {_TWO_64} ELSE h END AS h FROM (SELECT key, i, n, xor(h, h >> 32) AS h FROM (SELECT key, i, n, {times} AS h
FROM (SELECT key, i, n, ({hashed}) % {_TWO_64} AS h FROM (SELECT key, c, len(c) - {secrets.K - 1} AS n, unnest(range(1, len(c) - {secrets.K - 2})) AS i
FROM (SELECT key, list_transform(string_split(ltrim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ''), lambda x: CAST(unicode(x) AS HUGEINT)) AS c FROM {source}))))))) WHERE i = 1 OR i <= n - {secrets.W - 1})"""


@query(f"""WITH {_TURNS}, sent AS (SELECT s.id AS key, s.session_id, s.ts_ms, s.text || CASE WHEN (s.conv_id + s.ts_ms) % 3 = 0 THEN chr(10) || upper(replace(substr(coalesce(p.text, ''), 10, 40), ' ', '  ')) ELSE '' END AS text
  FROM t s LEFT JOIN t p ON p.session_id = s.session_id AND p.ts_ms = s.ts_ms - 1 WHERE s.role = 'user'),
read AS (SELECT id AS key, session_id, ts_ms, role, text FROM t WHERE role <> 'user'),
a AS MATERIALIZED {prints_sql("sent")}, b AS MATERIALIZED {prints_sql("read")},
hits AS (SELECT s.key AS id, min(CASE WHEN r.role = 'system' THEN 0 ELSE 1 END) AS n FROM a JOIN b USING (print) JOIN sent s ON s.key = a.key JOIN read r ON r.key = b.key AND r.session_id = s.session_id AND r.ts_ms < s.ts_ms GROUP BY 1)
SELECT id, CASE n WHEN 0 THEN 'notes' ELSE 'records' END AS flow, CASE n WHEN 0 THEN 'allow' ELSE 'deny' END AS action,
CASE n WHEN 0 THEN 'flow notes: data read from label:private may not go to app__exec, app__mail' ELSE 'query results stay out of commands' END AS reason FROM hits""")
def flow_contracts(spark, d):
    """Users who send a passage of what an assistant (a query) or the system (private) said before; a third copy one of the turn before, in capitals and with other blanks."""
    t = turns(spark, d)
    before = t.select(F.col("session_id").alias("_s"), (F.col("ts_ms") + 1).alias("_t"), F.col("text").alias("_said"))
    t = t.join(before, (F.col("session_id") == F.col("_s")) & (F.col("ts_ms") == F.col("_t")), "left")
    copied = F.when((F.col("conv_id") + F.col("ts_ms")) % 3 == 0, F.concat(F.lit("\n"), capitals(F.replace(F.substring(F.coalesce("_said", F.lit("")), 10, 40), F.lit(" "), F.lit("  "))))).otherwise("")
    user = F.col("role") == "user"
    tool = F.when(user, "exec").when(F.col("role") == "system", "note").otherwise("query")
    calls = t.select(
        "id", "session_id", "ts_ms", F.lit("app").alias("upstream"), tool.alias("tool_name"), F.concat(F.lit("app__"), tool).alias("tool"), F.when(user, F.concat("text", copied)).alias("args_json"),
        F.when(~user, F.col("text")).alias("result_text"), F.when(F.col("role") == "system", F.array(F.lit("private"))).otherwise(F.array().cast("array<string>")).alias("labels"),
    )
    return flows.flow_hits(calls, CONTRACTS, most=None)  # SQL keeps every fingerprint
