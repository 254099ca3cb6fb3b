"""Streams whose state outlives a micro-batch: shared labels, chains that go on, the day's spending, ends of sessions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import chain, ordered
from tracewell.sources import adapters
from tracewell.streaming import live

CALLS = "id string, session_id string, ts_ms long, labels array<string>"
START = 1_704_067_200_000


def fed(spark, tmp_path, rows, schema, parts, name):
    """A stream over ``parts`` files in turn, one micro-batch each."""
    src = tmp_path / name
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("part-*.parquet"):
            f.rename(src / f"{i:03}.parquet") if not f.name[0].isdigit() else None
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def collected(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r["id"], r["label"]) for r in stream.sparkSession.table(name).collect())


def plain_shared(rows, span):
    out = set()
    for i, s, at, _ in rows:
        out |= {(i, label) for j, other, then, labels in rows if other != s and at - span <= then < at for label in labels or []}
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 5])
def test_shared_labels_over_micro_batches(spark, tmp_path, shards):
    rng = random.Random(shards)
    rows = []
    for i in range(300):
        at = START + rng.randrange(0, 4 * 3_600_000, 60_000)  # many calls of one moment
        rows.append((f"c{i:03}", f"s{rng.randrange(6)}", at, rng.choice([None, [], [], ["pii"], ["pii", "web"], ["rare"] if i % 50 == 0 else []])))
    rows.sort(key=lambda r: r[2])
    order = sorted(range(300), key=lambda k: rows[k][2] + rng.randrange(0, 9 * 60_000))  # up to nine minutes late
    parts = [order[:100], [*order[100:200], *order[90:95]], order[200:]]  # five arrive twice
    end = [("end", "nobody", START + 24 * 3_600_000, None)]
    stream = fed(spark, tmp_path, rows + end, CALLS, [*parts, [300]], "calls")
    got = collected(live.earned_elsewhere(stream, "30 minutes", shards=shards), tmp_path, f"shared{shards}")
    want = plain_shared(rows, 30 * 60_000)
    assert got == want and len(want) > 300
    batch = ordered.shared_labels(spark.createDataFrame(rows, CALLS)).collect()
    assert sorted((r["id"], x) for r in batch for x in r["labels"].split(",")) == want


def test_late_calls_are_dropped(spark, tmp_path):
    rows = [("a", "s1", START, ["pii"]), ("b", "s2", START + 60_000, None), ("mark", "s3", START + 3_600_000, None), ("late", "s2", START + 120_000, None), ("c", "s2", START + 3_600_000 + 60_000, ["x"]), ("end", "s9", START + 10 * 3_600_000, None)]
    stream = fed(spark, tmp_path, rows, CALLS, [[0, 1], [2], [3, 4], [5]], "late")
    assert collected(live.earned_elsewhere(stream), tmp_path, "late") == [("b", "pii")]


def test_chains_go_on(spark, sf, tmp_path):
    calls = adapters.calls(spark, sf)
    calls.orderBy("ts_ms").repartitionByRange(3, "ts_ms").write.parquet(str(tmp_path / "calls"))
    stream = live.call_stream(spark, str(tmp_path / "calls"), calls.schema, 1)
    path = str(tmp_path / "log")
    q = live.append_chains(stream, path).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    links = lambda: spark.read.parquet(f"{path}/links")
    assert chain.verify(links()).count() == 0 and links().count() == calls.count() and links().where("epoch = 2").count() > 0
    in_order = links().select("epoch", "id").collect()
    # the files came in some order: the same appends, in one batch each, give the same links
    heads, built = None, {}
    for epoch in range(3):
        part = calls.where(F.col("id").isin([r["id"] for r in in_order if r["epoch"] == epoch]))
        one = chain.append(part, heads).select(*calls.columns, "prev_hash", "row_hash").cache()
        built |= {r["id"]: (r["seq"], r["row_hash"]) for r in one.collect()}
        new = chain.head_links(one)
        heads = new if heads is None else new.union(heads).groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))
    assert built == {r["id"]: (r["seq"], r["row_hash"]) for r in links().collect()}
    # a replayed micro-batch writes the same rows over its own
    before = sorted((r["id"], r["seq"], r["row_hash"]) for r in links().collect())
    part = calls.where(F.col("id").isin([r["id"] for r in in_order if r["epoch"] == 1]))
    live.chain_writer(path)(part, 1)
    assert sorted((r["id"], r["seq"], r["row_hash"]) for r in links().collect()) == before


def test_appended_equals_built(spark, sf):
    calls = adapters.calls(spark, sf)
    want = {r["id"]: (r["seq"], r["prev_hash"], r["row_hash"]) for r in chain.build(calls).collect()}
    first = chain.build(calls.where("ts_ms < 1705000000000"))
    second = chain.append(calls.where("ts_ms >= 1705000000000"), chain.head_links(first))
    assert {r["id"]: (r["seq"], r["prev_hash"], r["row_hash"]) for r in first.union(second).collect()} == want
    none = chain.append(calls.limit(0), chain.head_links(first))
    assert none.count() == 0


def test_spending_of_the_day(spark, sf, tmp_path):
    calls = adapters.calls(spark, sf)
    amount = F.when(F.col("tool") == "app__view", 0.25).otherwise(0.5)
    (tmp_path / "in").mkdir()
    for i in range(3):  # files in order of time
        calls.where(f"pmod(floor((ts_ms - {START}) / 864000000), 3) = {i}").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    stream = live.call_stream(spark, str(tmp_path / "in"), calls.schema, 1)
    path = str(tmp_path / "ledger")
    q = live.spend_ledger(stream, path, amount).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["spent"] for r in spark.read.parquet(f"{path}/spent").collect()}
    want = {r["id"]: r["spent"] for r in ordered.daily_ledger(calls, amount).collect()}
    assert got == pytest.approx(want) and len(got) > 500


def test_a_day_is_carried_over_micro_batches(spark, tmp_path):
    rows = [(f"c{i}", START + i * 3_600_000, "allow", False) for i in range(30)]
    schema = "id string, ts_ms long, decision string, shadow boolean"
    stream = fed(spark, tmp_path, rows, schema, [range(0, 10), [*range(20, 30), 15], range(10, 15)], "money")
    path = str(tmp_path / "ledger")
    q = live.spend_ledger(stream, path, F.lit(1.0)).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {int(r["id"][1:]): r["spent"] for r in spark.read.parquet(f"{path}/spent").collect()}
    assert [got[i] for i in range(10)] == list(range(1, 11))
    assert [got[i] for i in (15, 20, 23)] == [11, 12, 15] and [got[i] for i in range(24, 30)] == [1, 2, 3, 4, 5, 6]  # a new day starts at nothing
    assert [got[i] for i in range(10, 15)] == [16, 17, 18, 19, 20]  # late calls join their day at its end


def test_sessions_end_by_silence(spark, tmp_path):
    rows = [(f"c{i}", "s1", START + m * 60_000, None) for i, m in enumerate((0, 10, 35, 100, 110))] + [("x", "s2", START + 5 * 60_000, None), ("end", "s9", START + 9 * 3_600_000, None)]
    stream = fed(spark, tmp_path, rows, CALLS, [[0, 1, 5], [2, 3, 4], [6]], "ends")
    q = live.session_ends(stream).writeStream.format("memory").queryName("ends").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    minute = lambda ms: (ms - START) // 60_000
    got = sorted((r["session_id"], minute(r["started_ms"]), minute(r["ended_ms"]), r["calls"]) for r in spark.table("ends").collect())
    assert got == [("s1", 0, 65, 3), ("s1", 100, 140, 2), ("s2", 5, 35, 1)]
    assert json.loads(live.shaped("x", "discord")) == {"content": "x"}


SENT = "id string, session_id string, ts_ms long, upstream string, tool_name string, tool string, args_json string, result_text string, labels array<string>"
VALUE, ROWS = "q7Zr0pLx9TtVw3Kc", "Customer 42 is Ada Example of Station Road 7, owing 1234 euros."


def outgoing():
    def call(i, session, tool, args="", result="", labels=()):
        return (f"c{i:02}", session, START + i * 1000, "demo", tool, f"demo__{tool}", args, result, list(labels))

    return [
        call(0, "s", "exec", f"echo {VALUE} {ROWS}"), call(1, "s", "query", "select", ROWS), call(2, "s", "vault", "get", f"api_key = {VALUE}", ["private"]), call(3, "s", "exec", "ls -la"), call(4, "s", "exec", f"mail '{ROWS.upper()}'"),
        call(5, "s", "post", VALUE[::-1]), call(6, "t", "exec", f"{VALUE} {ROWS}"), call(7, "s", "post", VALUE.encode().hex().upper()), call(8, "s", "exec", "".join(f"%{c:02x}" for c in VALUE.encode())), call(9, "s", "vault", None, None),
    ]


@pytest.mark.parametrize("parts", [[range(10)], [range(3), range(3, 6), range(6, 10)]])
def test_what_leaves_a_session(spark, tmp_path, parts):
    """The stream's stops are those of the batch operators, over one micro-batch or several."""
    from tracewell.detect import flows

    contracts = flows.load_flows([{"id": "records", "from": ["demo.query"], "to": ["demo.exec"]}])
    rows = outgoing()
    stream = fed(spark, tmp_path, rows, SENT, parts, "calls")
    name = f"leaving{len(parts)}"
    q = live.leaving(stream, contracts, ("private",), ttl_ms=None).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["id"], r["rule"], r["what"], r["source"]) for r in spark.table(name).collect())
    df = spark.createDataFrame(rows, SENT)
    want = [(r["id"], "flow", r["flow"], None) for r in flows.flow_hits(df, contracts).collect()]
    private = df.where("array_contains(labels, 'private')").select("session_id", F.col("ts_ms").alias("at"), "id", F.col("result_text").alias("text"))
    sinks = df.select("session_id", F.col("ts_ms").alias("at"), "id", F.col("args_json").alias("text"))
    want += [(r["id"], "taint", r["encoding"], r["source"]) for r in flows.tainted_calls(private, sinks).collect()]
    assert got == sorted(want, key=lambda x: (x[0], x[1])) and [x[:3] for x in got] == [("c04", "flow", "records"), ("c05", "taint", "reversed"), ("c07", "taint", "hex"), ("c08", "taint", "plain")]


def test_bounds_and_silence(spark, tmp_path):
    """Only what was read first is kept up to the bounds; a session that is silent for long is forgotten."""
    from tracewell.detect import flows

    contracts = flows.load_flows([{"id": "records", "from": ["demo.query"], "to": ["demo.exec"]}])
    stream = fed(spark, tmp_path, outgoing(), SENT, [range(10)], "calls")
    q = live.leaving(stream, contracts, ("private",), most_prints=0, most_values=0, ttl_ms=None).writeStream.format("memory").queryName("bounded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bounded").count() == 0
    src = tmp_path / "slow"
    src.mkdir()
    put = lambda rows, name: spark.createDataFrame(rows, SENT).coalesce(1).write.parquet(str(tmp_path / name)) or next((tmp_path / name).glob("part-*")).rename(src / f"{name}.parquet")
    put(outgoing()[:3], "a")
    forgetful = live.leaving(spark.readStream.schema(SENT).parquet(str(src)), contracts, ("private",), ttl_ms=1000)
    q = forgetful.writeStream.format("memory").queryName("forgetful").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not (q.lastProgress and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1):
            time.sleep(0.5)
        while time.time() < end and q.lastProgress["stateOperators"][0]["numRowsTotal"] != 0:
            time.sleep(0.5)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
        put(outgoing()[4:5], "b")
        time.sleep(5)
    finally:
        q.stop()
    assert spark.table("forgetful").count() == 0
