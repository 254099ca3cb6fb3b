"""Order-dependent analytics over sessions: streaks, trailing windows, running state.

All are windows partitioned by session; long sessions sort on disk, none is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audit import went_through


def _ordered():
    return Window.partitionBy("session_id").orderBy("ts_ms", "id")


def loop_streaks(calls: DataFrame, signature=None) -> DataFrame:
    """How many calls right before this one had the same signature (default: tool and argument hash)."""
    sig = F.concat_ws("\x00", "tool", "args_hash") if signature is None else signature
    w = _ordered()
    c = calls.select("id", "session_id", "ts_ms", sig.alias("sig"))
    c = c.withColumn("new", F.coalesce((F.lag("sig").over(w) != F.col("sig")).cast("int"), F.lit(1)))
    c = c.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.select("id", (F.row_number().over(Window.partitionBy("session_id", "island").orderBy("ts_ms", "id")) - 1).cast("long").alias("streak"))


def trailing_rate(calls: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Forwarded calls of the session in the ``window_ms`` before each call: later calls of the same millisecond do not count."""
    w = Window.partitionBy("session_id").orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    peers = Window.partitionBy("session_id", "ts_ms").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    went = went_through().cast("int")
    return calls.select("id", (F.sum(went).over(w) - F.sum(went).over(peers)).cast("long").alias("rate"))


def running_counters(calls: DataFrame) -> DataFrame:
    """What the session had forwarded, with this tool and in tokens, before each call."""
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    by_tool = Window.partitionBy("session_id", "tool").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    went = went_through().cast("int")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    return calls.select("id", total(went, before).alias("session_calls"), total(went, by_tool).alias("tool_calls"), total(went * F.col("tokens_est"), before).alias("tokens"))


def first_labels(calls: DataFrame) -> DataFrame:
    """The call that first earned each label of a session."""
    each = calls.select("session_id", "id", "ts_ms", F.explode("labels").alias("label"))
    return each.groupBy("session_id", "label").agg(F.min(F.struct("ts_ms", "id")).alias("f")).select("session_id", "label", F.col("f.id").alias("id"))


def called_so_far(calls: DataFrame) -> DataFrame:
    """The tools a session had called before each call, sorted."""
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    return calls.select("id", F.array_join(F.array_sort(F.collect_set("tool").over(before)), ",").alias("called"))


def shared_labels(calls: DataFrame, within_ms: int = 30 * 60_000, slices: int = 30) -> DataFrame:
    """Labels other sessions earned in the ``within_ms`` before each call.

    Another session earned a label in the time if its smallest or its largest session there is not the call's own. Time is
    cut into ``slices`` buckets a window: whole buckets inside a call's window are known by their two sessions, and only in
    the two buckets where the window begins and ends calls and earnings are put in order. So a task orders one label's
    traffic of a bucket, a minute here, and no pairs are made.
    """
    slices = slices if within_ms % slices == 0 else 1
    g = within_ms // slices
    bucket, text = F.floor(F.col("ts_ms") / g).cast("long").alias("b"), F.lit(None).cast("string")
    earned = calls.select("session_id", "ts_ms", F.explode("labels").alias("label")).groupBy("ts_ms", "label").agg(F.min("session_id").alias("low"), F.max("session_id").alias("high")).select("*", bucket)
    asked = calls.select("id", "session_id", "ts_ms", bucket)  # the window begins in bucket b - slices and ends in b
    # whole buckets between: of each label and bucket, however many calls ask
    whole = earned.groupBy("label", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    seen = whole.select("label", F.explode(F.sequence(F.col("b") + 1, F.col("b") + slices - 1)).alias("b"), "low", "high") if slices > 1 else whole.where("false")
    seen = seen.groupBy("label", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    inner = asked.join(seen, "b").select("id", "session_id", "label", "low", "high")
    # the ends: a call is put in order among what was earned in either bucket
    probe = lambda at, b, ends: asked.select("id", "session_id", at.alias("at"), b.alias("b"), F.lit(ends).alias("ends"))
    probes = probe(F.col("ts_ms"), F.col("b"), True).unionByName(probe(F.col("ts_ms") - within_ms, F.col("b") - slices, False)).join(whole.select("label", "b"), "b")
    rows = earned.select("label", "b", F.col("ts_ms").alias("at"), "low", "high", text.alias("id"), text.alias("session_id"), F.lit(None).cast("boolean").alias("ends"))
    both = rows.unionByName(probes.select("label", "b", "at", text.alias("low"), text.alias("high"), "id", "session_id", "ends"))
    # two running frames, one from either end: a frame that is open at its far end is gone through anew for every row
    before = Window.partitionBy("label", "b").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("label", "b").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    pick = lambda f, c: F.when(F.col("ends"), f(c).over(before)).otherwise(f(c).over(after))
    part = both.select("id", "session_id", "label", pick(F.min, "low").alias("low"), pick(F.max, "high").alias("high")).where("id IS NOT NULL")
    hits = part.unionByName(inner).where("low <> session_id OR high <> session_id")
    return hits.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def daily_ledger(calls: DataFrame, amount, bucket_ms: int = 60_000) -> DataFrame:
    """Spent since midnight over all sessions, with each forwarded call.

    Calls of a minute are summed in order by one task; the minutes before it that day come from their totals.
    """
    c = calls.where(went_through()).select("id", F.floor(F.col("ts_ms") / bucket_ms).cast("long").alias("bucket"), F.floor(F.col("ts_ms") / 86_400_000).cast("long").alias("day"), "ts_ms", amount.alias("amount"))
    totals = c.groupBy("day", "bucket").agg(F.sum("amount").alias("amount"))
    earlier = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a minute
    totals = totals.select("day", "bucket", F.coalesce(F.sum("amount").over(earlier), F.lit(0.0)).alias("before"))
    w = Window.partitionBy("day", "bucket").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("inside", F.sum("amount").over(w)).join(totals, ["day", "bucket"]).select("id", F.round(F.col("before") + F.col("inside"), 6).alias("spent"))


def mock_answers(recorded: DataFrame, requests: DataFrame) -> DataFrame:
    """The n-th request of a (tool, args) gets the n-th recorded answer, the last one repeats.

    ``recorded``: tool, args_hash, ts_ms, id, result_json; ``requests``: request_id, tool, args_hash.
    """
    key = ["tool", "args_hash"]
    r = recorded.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ts_ms", "id"))).select(*key, "n", "result_json")
    most = r.groupBy(*key).agg(F.max("n").alias("most"))
    q = requests.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("request_id"))).join(most, key, "left").withColumn("n", F.least("n", "most"))
    return q.join(r, [*key, "n"], "left").select("request_id", *key, "result_json")


def top_frame(calls: DataFrame, now_ms: int, tools: int = 8) -> DataFrame:
    """The busiest tools of the last hour, with their last minute."""
    c = calls.where((F.col("ts_ms") > now_ms - 3_600_000) & (F.col("ts_ms") <= now_ms))
    out = c.groupBy("tool").agg(F.count("*").alias("hour"), F.count_if(F.col("ts_ms") > now_ms - 60_000).alias("minute"))
    return out.orderBy(F.desc("hour"), "tool").limit(tools)
