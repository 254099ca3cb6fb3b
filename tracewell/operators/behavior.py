"""Behaviour profiles of tools, and what departs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import went_through


def arg_keys(args_json: Column) -> Column:
    """The top-level argument names, sorted; none for what is not an object."""
    return F.coalesce(F.array_sort(F.json_object_keys(args_json)), F.array().cast("array<string>"))


def quantiles(calls: DataFrame, value: str, qs=(0.5, 0.95)) -> DataFrame:
    """Per tool the values at index min(n - 1, floor(q * n)) of the sorted values, and the largest.

    Values are counted first; the window runs over a tool's distinct values only.
    """
    each = calls.groupBy("tool", value).agg(F.count("*").alias("n")).where(F.col(value).isNotNull())
    upto = F.sum("n").over(Window.partitionBy("tool").orderBy(value))
    c = each.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("tool")))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * q)), F.col(value)))
    return c.groupBy("tool").agg(*[at(q).alias(f"{value}_p{int(q * 100)}") for q in qs], F.max(value).alias(f"{value}_max"))


def profile(calls: DataFrame) -> DataFrame:
    """One row a tool: calls, error rate, quantiles of result size and duration, argument names, labels, last call."""
    c = calls.where(went_through())
    base = c.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.avg(F.col("is_error").cast("double")), 6).alias("error_rate"), F.max("ts_ms").alias("to_ms"))
    names = lambda values, name: c.select("tool", F.explode(values).alias("v")).distinct().groupBy("tool").agg(F.array_sort(F.collect_list("v")).alias(name))
    out = base.join(quantiles(c, "result_bytes"), "tool").join(quantiles(c, "duration_ms"), "tool")
    out = out.join(names(arg_keys(F.col("args_json")), "arg_keys"), "tool", "left").join(names(F.col("labels"), "labels"), "tool", "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("arg_keys", F.coalesce("arg_keys", empty)).withColumn("labels", F.coalesce("labels", empty))


def anomalies(calls: DataFrame, profiles: DataFrame, min_calls: int = 20, factor: float = 4.0) -> DataFrame:
    """Calls that depart from their tool's profile: id, kind, detail. Tools without (enough of) a profile have none."""
    p = profiles.where(F.col("calls") >= min_calls).select("tool", *[F.col(c).alias(f"p_{c}") for c in ("result_bytes_p95", "result_bytes_max", "duration_ms_p95", "duration_ms_max", "arg_keys", "labels")])
    j = calls.join(p, "tool")
    limit = lambda v, floor: F.greatest(factor * F.greatest(F.col(f"p_{v}_p95"), F.lit(1)), F.lit(float(floor)), F.col(f"p_{v}_max").cast("double"))
    new = lambda own, known: F.array_except(own, known)
    hit = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("detail")))
    big = lambda kind, v, floor: F.when(F.col(v) > limit(v, floor), F.array(F.struct(F.lit(kind).alias("kind"), F.col(v).cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<kind:string,detail:string>>"))
    slow = F.greatest(factor * F.greatest(F.col("p_duration_ms_p95"), F.lit(1)), F.lit(2000.0))
    late = F.when(F.col("duration_ms") > slow, F.array(F.struct(F.lit("slow").alias("kind"), F.col("duration_ms").cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<kind:string,detail:string>>"))
    found = F.concat(hit("new-argument", new(arg_keys(F.col("args_json")), F.col("p_arg_keys"))), big("result-size", "result_bytes", 4096), late, hit("new-label", new(F.col("labels"), F.col("p_labels"))))
    return j.select("id", F.inline(found))
