from pyspark.sql import functions as F

from tracewell.operators import ordered
from tracewell.sources import adapters
from tracewell.streaming import live


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def stream(spark, sf, tmp_path, files=4):
    calls = adapters.calls(spark, sf)
    calls.orderBy("ts_ms").repartitionByRange(files, "ts_ms").write.parquet(str(tmp_path / "calls"))
    return calls, live.call_stream(spark, str(tmp_path / "calls"), calls.schema)


def test_sliding_rates(spark, sf, tmp_path):
    calls, s = stream(spark, sf, tmp_path)
    got = {(r["start_ms"], r["tool"]): r["calls"] for r in run(live.tool_rates(s, "1 day", "1 day"), "rates", "update")}
    day = (F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000).alias("start_ms")
    want = {(r["start_ms"], r["tool"]): r["count"] for r in calls.groupBy(day, "tool").count().collect()}
    assert got == want


def test_tail_in_chain_order(spark, sf, tmp_path):
    calls, s = stream(spark, sf, tmp_path)
    seen = []
    q = live.tail(s, lambda rows: seen.extend(r["seq"] for r in rows.collect()), last_seq=99).start()
    q.processAllAvailable()
    q.stop()
    assert seen == sorted(seen) and seen == list(range(100, calls.count()))


def test_session_state_equals_batch(spark, sf, tmp_path):
    calls, s = stream(spark, sf, tmp_path, files=1)
    got = {r["id"]: (r["session_calls"], r["tokens"]) for r in run(live.session_counters(s, ttl_ms=None), "counters")}
    want = {r["id"]: (r["session_calls"], r["tokens"]) for r in ordered.running_counters(calls).collect()}
    assert got == want


def test_notifications(spark, sf):
    rows = live.notifications(adapters.calls(spark, sf)).collect()
    assert rows and all('"event":"' in r["value"] for r in rows)
    assert live.shaped("hi", "slack") == '{"text": "hi"}'
