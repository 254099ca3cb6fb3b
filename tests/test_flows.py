import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.detect import flows
from tracewell.policy import columns, model

VALUE = "q7Zr0pLx9TtVw3Kc"
CALLS = "id string, session_id string, ts_ms long, upstream string, tool_name string, tool string, args_json string, result_text string, labels array<string>"
ROWS = "Customer 42 is Ada Example of Station Road 7, owing 1234 euros."


def call(i, tool, args="", result="", session="s", labels=()):
    return (f"c{i}", session, i, "demo", tool, f"demo__{tool}", args, result, list(labels))


def contract(**more):
    return flows.load_flows([{"id": "no-records-to-shell", "from": ["demo.query"], "to": ["demo.exec"], "reason": "query results stay out of shell commands"} | more])


def hits(spark, rows, contracts, **options):
    return {r["id"]: (r["flow"], r["action"], r["reason"]) for r in flows.flow_hits(spark.createDataFrame(rows, CALLS), contracts, **options).collect()}


def test_contract_stops_copies_of_what_was_read(spark):
    rows = [
        call(1, "exec", f"echo '{ROWS}'"), call(2, "query", "SELECT", ROWS), call(3, "exec", "ls -la /srv/app"), call(4, "exec", f"echo '{ROWS}' | mail ops"),
        call(5, "exec", "echo customer 42\n  IS ada   example OF station road 7"), call(6, "mail", ROWS), call(7, "exec", ROWS, session="other"), call(8, "exec", None), call(9, "query", ROWS, None),
    ]
    reason = "query results stay out of shell commands"
    want = {k: ("no-records-to-shell", "deny", reason) for k in ("c4", "c5")}
    assert hits(spark, rows, contract()) == hits(spark, rows, contract(), most=None) == want
    assert hits(spark, rows, contract(action="warn")) == {k: ("no-records-to-shell", "allow", reason) for k in want}
    assert hits(spark, rows, contract(), most=0) == {} and hits(spark, [], contract()) == {}
    # the first contract decides; labels make a source of any tool
    both = flows.load_flows([{"id": "a", "from": ["label:pii"], "to": ["*"], "action": "ask"}]) + contract()
    labelled = [call(1, "page", "", ROWS, labels=["pii"]), *rows[1:]]
    got = hits(spark, labelled, both)
    assert {k: v[:2] for k, v in got.items()} == {"c4": ("a", "ask"), "c5": ("a", "ask"), "c6": ("a", "ask"), "c9": ("a", "ask")}
    assert got["c6"][2] == "flow a: data read from label:pii may not go to *"


def test_contracts_report_every_mistake():
    with pytest.raises(flows.FlowError) as e:
        flows.load_flows([{"id": "a", "from": ["x"]}, {"id": "a", "from": ["x"], "to": ["y"], "action": "stop"}, {"from": ["x"], "to": ["y"]}])
    assert str(e.value).splitlines() == ["flow 0: both from and to are needed", "flow 1: the id is used twice", "flow 1: action 'stop'", "flow 2: it has no id"]


def test_stricter_decision_stands(spark):
    p = model.load({"rules": [{"id": "no", "tool": "demo.exec", "when": {"args.force": {"equals": True}}, "action": "deny"}]})
    rows = [call(1, "query", "{}", ROWS), call(2, "exec", f'{{"c":"{ROWS}"}}'), call(3, "exec", f'{{"c":"{ROWS}","force":true}}'), call(4, "exec", "{}")]
    df = spark.createDataFrame(rows, CALLS)
    found = flows.flow_hits(df, contract(action="ask"))
    got = {r["id"]: tuple(r["verdict"])[::2] for r in flows.with_flow(columns.evaluate(df, p), found).collect()}
    assert got == {"c1": ("allow", ""), "c2": ("ask", "flow"), "c3": ("deny", "no"), "c4": ("allow", "")}


def test_tainted_values_in_every_spelling(spark, monkeypatch):
    b64 = base64.b64encode(f"x{VALUE}y".encode()).decode()
    texts = [f"a {VALUE} b", VALUE[::-1], VALUE.encode().hex().upper(), b64, b64.replace("+", "-"), "".join(f"%{c:02x}" for c in VALUE.encode()), "nothing", None, "", VALUE[:-1]]
    names = ["plain", "reversed", "hex", "base64", "base64", "plain"]
    src = [("s", 5, "r1", f"password: {VALUE}"), ("s", 7, "r2", f"token={VALUE}\nsecret = another0Value9"), ("t", 1, "r3", "api_key=changeme-placeholder"), ("s", 1, "r0", None)]
    df = spark.createDataFrame(src, "session_id string, at long, id string, text string")
    out = spark.createDataFrame([("s", 10 + i, f"c{i}", t) for i, t in enumerate(texts)] + [("s", 5, "same", VALUE), ("t", 99, "other", VALUE), ("s", 50, "both", f"{VALUE} another0Value9")], df.schema)
    want = {(f"c{i}", VALUE, "r1", n) for i, n in enumerate(names)} | {("both", VALUE, "r1", "plain"), ("both", "another0Value9", "r2", "plain")}
    got = lambda **o: sorted(tuple(r) for r in flows.tainted_calls(df, out, **o).collect())
    assert got() == got(most=None) == sorted(want)
    assert got(most=1) == sorted(w for w in want if w[1] == VALUE)  # the first values are kept
    monkeypatch.setattr(flows, "BLOCK_VALUES", 1)
    monkeypatch.setattr(flows, "CHUNK_BYTES", 40)
    assert got() == sorted(want)
    assert flows.tainted_calls(df.limit(0), out).count() == 0


def test_many_values_of_one_session(spark):
    """Every value of a session is found beyond one automaton's block."""
    values = [hashlib.sha256(str(i).encode()).hexdigest()[:20] for i in range(2500)]
    src = spark.createDataFrame([("s", i, f"r{i:04}", f"api_key={v}") for i, v in enumerate(values)], "session_id string, at long, id string, text string")
    out = src.select("session_id", (F.col("at") + 5000).alias("at"), F.concat(F.lit("c"), "id").alias("id"), F.substring("text", 9, 20).alias("text"))
    assert flows.tainted_calls(src, out, most=None).where("encoding = 'plain' AND id = concat('c', source)").count() == 2500
    assert flows.tainted_calls(src, out).count() == 1000


def test_copies_in_capitals_equal_sql_beyond_ascii(spark, tmp_path):
    import duckdb

    from tracewell.plans import flow_queries

    said = ["Vor der Große Straße süß, weiß fließt ein heißer Fluß.", "ΟΔΟΣ ΜΕΓΑΣ ΛΟΓΟΣ ΚΑΛΟΣ ΤΟΠΟΣ ΝΕΟΣ ΠΑΛΑΙΟΣ", "abcdefghi ﬁne ŉ ǰ ᾳ ᾀ oﬃce ﬂow İstanbul ῖ", "abcdefgh ordinary words of a plain passage here"]
    rows = [(3 * c, turn, role, text) for c, x in enumerate(said) for turn, role, text in ((2, "assistant", x), (3, "user", "so"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(flow_queries.ORACLES["flow_contracts"]).fetchall())
    assert want and sorted(map(tuple, flow_queries.flow_contracts(spark, str(tmp_path)).collect())) == want
