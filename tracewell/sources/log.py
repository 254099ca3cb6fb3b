"""Readers and writers of the call log.

Schemas are explicit, never inferred; columns that older files lack get their
defaults, so logs of any version are read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()
#: column -> (type, default of older files)
CALL_COLUMNS = {
    "id": (S, ""), "session_id": (S, ""), "ts_ms": (L, None), "upstream": (S, ""), "tool": (S, ""), "args_json": (S, ""),
    "args_hash": (S, ""), "decision": (S, ""), "rule_id": (S, ""), "reason": (S, ""), "result_json": (S, ""), "result_hash": (S, ""),
    "is_error": (B, False), "duration_ms": (L, 0), "tokens_est": (L, 0), "result_truncated": (B, False), "error": (S, ""),
    "shadow": (B, False), "labels": (T.ArrayType(S), ()), "catalog_hash": (S, ""), "seq": (L, None), "prev_hash": (S, ""), "row_hash": (S, ""),
}
SESSION_COLUMNS = {"id": (S, ""), "started_ms": (L, None), "ended_ms": (L, None), "host_name": (S, ""), "host_version": (S, ""), "downstream_transport": (S, ""), "catalog_hash": (S, "")}
CATALOG_COLUMNS = {"hash": (S, ""), "json": (S, ""), "created_ms": (L, None)}
ANCHOR_COLUMNS = {"seq": (L, None), "hash": (S, ""), "pruned_ms": (L, None)}


def upgraded(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with exactly these columns, missing ones and nulls replaced by their defaults."""

    def column(name: str, kind: T.DataType, default) -> Column:
        value = F.array().cast(kind) if default == () else F.lit(default).cast(kind)
        if name not in df.columns:
            return value.alias(name)
        own = F.col(name).cast(kind)
        return (own if default is None else F.coalesce(own, value)).alias(name)

    return df.select(*[column(n, k, d) for n, (k, d) in columns.items()])


def read(spark: SparkSession, path: str, columns: dict = CALL_COLUMNS) -> DataFrame:
    """A log table of any version."""
    return upgraded(spark.read.option("mergeSchema", "true").parquet(path), columns)


def write_calls(calls: DataFrame, path: str, mode: str = "append") -> None:
    """Calls by day, a session's calls side by side: time filters prune folders, session filters prune row groups."""
    day = F.to_date(F.timestamp_millis("ts_ms"))
    calls.withColumn("day", day).repartition("day", "session_id").sortWithinPartitions("session_id", "ts_ms", "id").write.mode(mode).partitionBy("day").parquet(path)


def end_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends``: id, ended_ms -> the sessions with their end set; a later end wins."""
    e = ends.groupBy("id").agg(F.max("ended_ms").alias("_end"))
    return sessions.join(e, "id", "left").withColumn("ended_ms", F.coalesce("_end", "ended_ms")).drop("_end").select(sessions.columns)


def new_catalogs(catalogs: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Of the arrivals the catalogs not yet stored, each once, the earliest."""
    first = arrivals.groupBy("hash").agg(F.min(F.struct("created_ms", "json")).alias("f")).select("hash", F.col("f.json").alias("json"), F.col("f.created_ms").alias("created_ms"))
    return first.join(catalogs.select("hash"), "hash", "left_anti")


def latest_catalog(catalogs: DataFrame) -> DataFrame:
    """The catalog stored last (of equal times the larger hash), one row or none."""
    return catalogs.orderBy(F.desc("created_ms"), F.desc("hash")).limit(1)


def catalog_by_hash(catalogs: DataFrame, hash_: str) -> DataFrame:
    return catalogs.where(F.col("hash") == hash_)


HINTS = "struct<title:string,readOnlyHint:boolean,destructiveHint:boolean,idempotentHint:boolean,openWorldHint:boolean>"


def annotations(catalogs: DataFrame) -> DataFrame:
    """``catalogs``: hash, json -> catalog_hash, tool and annotations struct of every tool, as policies look at them.

    Defaults of the protocol: with annotations, a tool is destructive unless it says so or is read-only, and open to the
    world unless it says not. A tool without annotations has a null struct.
    """
    entries = F.from_json("json", f"array<struct<exposed:string,tool:struct<annotations:{HINTS}>>>")
    t = catalogs.select(F.col("hash").alias("catalog_hash"), F.inline(entries)).select("catalog_hash", F.col("exposed").alias("tool"), F.col("tool.annotations").alias("a"))
    read_only = F.coalesce("a.readOnlyHint", F.lit(False))
    hints = F.struct(
        F.col("a.title").alias("title"), read_only.alias("read_only"), F.when(read_only, False).otherwise(F.coalesce("a.destructiveHint", F.lit(True))).alias("destructive"),
        F.coalesce("a.idempotentHint", F.lit(False)).alias("idempotent"), F.coalesce("a.openWorldHint", F.lit(True)).alias("open_world"),
    )
    return t.select("catalog_hash", "tool", F.when(F.col("a").isNotNull(), hints).alias("annotations"))


def with_annotations(calls: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Calls with title, read_only, destructive, idempotent and open_world, as their catalog has them for their tool; only catalogs that calls name are taken apart."""
    named = catalogs.join(calls.select(F.col("catalog_hash").alias("hash")).distinct(), "hash", "left_semi")
    each = annotations(named).dropDuplicates(["catalog_hash", "tool"]).select("catalog_hash", "tool", "annotations.*")
    return calls.join(each, ["catalog_hash", "tool"], "left")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchor files: JSON statements or ``seq:hash`` lines, ``#`` comments -> seq, hash."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parsed = F.from_json("line", "seq long, hash string")
    plain = F.regexp_extract("line", r"^(\d+)\s*:\s*([0-9a-f]{64})$", 0)
    seq = F.when(plain != "", F.regexp_extract("line", r"^(\d+)", 1).try_cast("long")).otherwise(parsed["seq"])
    hash_ = F.when(plain != "", F.regexp_extract("line", r"([0-9a-f]{64})$", 1)).otherwise(parsed["hash"])
    return lines.select(seq.alias("seq"), hash_.alias("hash")).where("seq IS NOT NULL AND hash IS NOT NULL")


def spans(calls: DataFrame, prefix: str = "tracewell") -> DataFrame:
    """Calls as tracing spans: ids from hashes of session and call, status deny > error > is_error."""
    trace = F.substring(F.sha2(F.concat(F.lit(f"{prefix}:session:"), "session_id"), 256), 1, 32)
    span = F.substring(F.sha2(F.concat(F.lit(f"{prefix}:call:"), "id"), 256), 1, 16)
    blocked = (F.col("decision") == "deny") & ~F.col("shadow")
    status = F.when(blocked, "denied").when(F.col("is_error"), "error").otherwise("ok")
    return calls.select(trace.alias("trace_id"), span.alias("span_id"), F.col("tool").alias("name"), (F.col("ts_ms") * 1000000).alias("start_ns"), ((F.col("ts_ms") + F.col("duration_ms")) * 1000000).alias("end_ns"), status.alias("status"))


REGISTRY_RECORD = "struct<index: bigint, path: string, server: string, version: string, hash: string, at: string>"


def registry_log(spark: SparkSession, path: str) -> DataFrame:
    """A registry's log, a JSON record a line -> place (from 0), index, path, server, version, hash, at, leaf.

    The leaf is the hash of the line's very bytes, as RFC 6962 hashes leaves, so a record written in other words is another
    one. Blank lines are none; a line that is no record has nulls, and its leaf. Lines are numbered in the order of the
    file however Spark splits it: by block of the file, then by their place in it. A file that isn't there is an empty log.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    lines = lines.withColumn("value", value).where(F.octet_length(F.btrim("value", F.lit(" \t\r\x0b\x0c"))) > 0)
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))  # a row a block
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    placed = lines.withColumn("own", own).join(F.broadcast(ahead), ["file", "block"])
    r = F.from_json("value", REGISTRY_RECORD)
    leaf = F.sha2(F.concat(F.lit(b"\x00"), F.col("value").cast("binary")), 256)
    return placed.select((F.col("ahead") + F.col("own")).cast("long").alias("place"), *(r[c].alias(c) for c in ("index", "path", "server", "version", "hash", "at")), leaf.alias("leaf"))


def tree_head(text: str) -> tuple[int, str]:
    """(size, root) of a noted head, written size:root, the root with or without its sha256 mark."""
    size, _, root = text.strip().partition(":")
    root = re.sub(r"^sha256:?", "", root.strip())
    if not size.isdigit() or not re.fullmatch(r"[0-9a-f]{64}", root):
        raise ValueError(f"not a head: {text!r}")
    return int(size), root
