"""The call log's tables out of the driver's parquet tables.

An adapter is one SQL text for both engines: where their dialects part, a
``{name}`` stands for the fragment of ``DIALECTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fragments by engine. ``events`` and ``customer`` are the tables' names in a query.
DIALECTS = {
    "spark": {"ts_ms": "unix_millis(CAST(ts AS TIMESTAMP))", "list": "array", "open": "(", "close": ")", "empty": "CAST(array() AS ARRAY<STRING>)"},
    "duckdb": {"ts_ms": "epoch_us(ts) // 1000", "list": "", "open": "[", "close": "]", "empty": "CAST([] AS VARCHAR[])"},
}

#: One call an event: a user's events are a session, the event type is the tool.
CALLS = """
SELECT lpad(CAST(event_id AS STRING), 12, '0') AS id, concat('u', CAST(user_id AS STRING)) AS session_id,
       CAST({ts_ms} AS BIGINT) AS ts_ms, 'app' AS upstream, concat('app__', event_type) AS tool, props AS args_json,
       sha256_hex AS args_hash, decision,
       CASE WHEN decision = 'allow' THEN '' WHEN event_id % 5 = 0 THEN 'honeypot' WHEN event_id % 5 = 1 THEN 'canary'
            WHEN event_id % 5 = 2 THEN 'no-clicks' WHEN event_id % 5 = 3 THEN 'quarantine' ELSE 'slow-down' END AS rule_id,
       CASE WHEN event_id % 7 = 0 THEN 'approved by owner' WHEN event_id % 7 = 1 THEN 'rejected by owner' ELSE '' END AS reason,
       event_type = 'error' AS is_error, CAST(floor(value * 10) AS BIGINT) AS duration_ms,
       CAST(floor(length(props) / 4) AS BIGINT) AS tokens_est, decision <> 'allow' AND event_id % 3 = 0 AS shadow,
       CASE WHEN event_id % 4 = 0 THEN {list}{open}'private-data'{close}
            WHEN event_id % 4 = 1 THEN {list}{open}'private-data', 'untrusted-input'{close} ELSE {empty} END AS labels,
       CAST(floor(value * 40) AS BIGINT) AS result_bytes, event_id AS seq
FROM (SELECT *, sha2_of_props AS sha256_hex,
             CASE WHEN event_id % 11 = 0 THEN 'deny' WHEN event_id % 17 = 0 THEN 'ask' ELSE 'allow' END AS decision
      FROM (SELECT *, {sha} AS sha2_of_props FROM {events}))
"""
DIALECTS["spark"]["sha"], DIALECTS["duckdb"]["sha"] = "sha2(props, 256)", "sha256(props)"

#: One session a user: from its first to its last event; every ninth still runs.
SESSIONS = """
SELECT e.session_id AS id, e.started_ms, CASE WHEN e.user_id % 9 = 0 THEN NULL ELSE e.ended_ms END AS ended_ms,
       coalesce(c.c_mktsegment, '') AS host_name
FROM (SELECT user_id, concat('u', CAST(user_id AS STRING)) AS session_id, min(CAST({ts_ms} AS BIGINT)) AS started_ms, max(CAST({ts_ms} AS BIGINT)) AS ended_ms
      FROM {events} GROUP BY user_id) e
LEFT JOIN {customer} c ON c.c_custkey = e.user_id
"""


def sql(adapter: str, engine: str, **tables: str) -> str:
    """The adapter's text for an engine; tables stand for themselves unless named."""
    return adapter.format(**DIALECTS[engine], **({"events": "events", "customer": "customer"} | tables))


def frame(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    """The adapter over the parquet tables of ``sf_dir``."""
    need = [t for t in ("events", "customer") if "{" + t + "}" in adapter]
    text = sql(adapter, "spark", **{t: "{" + t + "}" for t in need})
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in need})


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CALLS)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SESSIONS)


def with_adapters(text: str) -> str:
    """A DuckDB query that may read ``calls`` and ``sessions``."""
    body = text.strip()
    more = body[4:].strip() if body[:5].upper() == "WITH " else None
    head = f"WITH calls AS ({sql(CALLS, 'duckdb')}), sessions AS ({sql(SESSIONS, 'duckdb')})"
    return f"{head}, {more}" if more else f"{head} {body}"
