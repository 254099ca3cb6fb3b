"""Tests of a policy as sessions: cases written down, or taken from recorded sessions, played through the fold.

A case is a session of its own, so all cases of all files are one table of calls
and one of expectations, and ``session.replay`` plays them side by side.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import document_hash, tokens_estimate
from . import session
from .model import Policy

# What is said of an expectation that was not met.
SAID = {
    "action": "want {want}, got {action}: {why}",
    "rule": "want rule {want_rule}, got {rule}",
    "no rule": "no rule (the default decided)",
    "reason": 'want a reason containing "{want_reason}", got "{reason}"',
    "label": "want the session labelled {label} after the call; it is not",
}
#: Decisions that no policy reached: a test of the policy cannot reproduce them.
NOT_POLICY = ("honeypot", "canary", "quarantine", "frozen")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CALLS = (
    "id string, session_id string, ts_ms long, tool string, upstream string, tool_name string, args_json string, decision string, host_name string, host_version string, initial_labels array<string>, title string, "
    "read_only boolean, destructive boolean, idempotent boolean, open_world boolean, result_text string, result_is_error boolean"
)
EXPECTED = "id string, case string, step int, action string, rule string, reason string, labels array<string>"


class CaseError(ValueError):
    """A case that cannot be read."""


def parse_when(text: str, now: dt.datetime) -> dt.datetime:
    """A time: RFC 3339, a date with or without a clock, a clock of today, or the next such day of the week with a clock."""
    said = text.strip()
    for layout in ("%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(said, layout).replace(tzinfo=now.tzinfo)
        except ValueError:
            pass
    day, _, clock = said.lower().rpartition(" ")
    try:
        at = dt.datetime.strptime(clock, "%H:%M").time()
    except ValueError:
        at = None
    if at is not None and not day:
        return now.replace(hour=at.hour, minute=at.minute, second=0, microsecond=0)
    named = [i for i, d in enumerate(DAYS) if day and d.startswith(day.strip())]
    if at is not None and named:
        ahead = min((i - now.weekday()) % 7 for i in named)
        return (now + dt.timedelta(days=ahead)).replace(hour=at.hour, minute=at.minute, second=0, microsecond=0)
    try:
        return dt.datetime.fromisoformat(said.replace("Z", "+00:00"))
    except ValueError:
        raise CaseError(f"no time: {text!r}") from None


def _expected(e) -> tuple[str, str, str, list[str]]:
    e = {"action": e} if isinstance(e, str) else e
    return e["action"], e.get("rule") or "", e.get("reason") or "", e.get("labels") or []


def load_cases(spark: SparkSession, tests: list[dict], now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Cases (name, host, at, labels; before, call and expect, or steps) -> (calls, expectations).

    A step is made ``repeat`` times and expected each time; the call of a case is its last step.
    """
    calls, expected = [], []
    for n, c in enumerate(tests):
        at = parse_when(c["at"], now) if c.get("at") else now
        host, _, version = (c.get("host") or "").partition("/")
        steps = c.get("steps") or [*(c.get("before") or []), {**c["call"], "expect": c.get("expect")}]
        k = 0
        for i, s in enumerate(steps, 1):
            when = parse_when(s["at"], now) if s.get("at") else at
            upstream, _, name = s["tool"].partition("." if "." in s["tool"] else "__")
            a, r = s.get("annotations") or {}, s.get("result")
            args = None if s.get("args") is None else json.dumps(s["args"], separators=(",", ":"), ensure_ascii=False)
            for _ in range(max(s.get("repeat") or 1, 1)):
                key = f"{n:06}-{k:06}"
                k += 1
                calls.append((key, f"{n:06}", int(when.timestamp() * 1000), f"{upstream}__{name}" if name else upstream, upstream if name else "", name or upstream, args, "allow", host, version, c.get("labels") or [],
                              a.get("title"), a.get("read_only"), a.get("destructive"), a.get("idempotent"), a.get("open_world"), r.get("text", "") if r else None, bool(r.get("is_error")) if r else None))
                if s.get("expect"):
                    expected.append((key, c["name"], i, *_expected(s["expect"])))
    out = spark.createDataFrame(calls, CALLS)
    return out.withColumns({"args_hash": document_hash(F.col("args_json")), "tokens_est": tokens_estimate(F.col("args_json"), F.col("result_text"))}), spark.createDataFrame(expected, EXPECTED)


def run_cases(calls: DataFrame, expected: DataFrame, p: Policy) -> DataFrame:
    """id, case, step, action, rule_id, problems (sentences, none if the case passed there) of every expectation.

    Calls go through unless they are denied: an ask counts as approved, since the calls of a case are what the session did.
    """
    e = expected.select(F.col("id").alias("_id"), "case", "step", F.col("action").alias("want"), F.col("rule").alias("want_rule"), F.col("reason").alias("want_reason"), F.col("labels").alias("want_labels"))
    j = session.replay(calls, p).join(e, F.col("id") == F.col("_id"))
    parts = {
        "rule": F.when(F.col("rule_id") == "", SAID["no rule"]).otherwise(F.col("rule_id")),
        "why": F.when(F.col("rule_id") == "", F.col("reason")).otherwise(F.concat("reason", F.lit(" (rule "), "rule_id", F.lit(")"))),
    }

    def said(name: str, **more) -> Column:
        pieces = re.split(r"\{(\w+)\}", SAID[name])
        return F.concat(*[(parts | more).get(x, F.col(x)) if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])

    same = F.col("action") == F.col("want")
    found = F.array(
        F.when(~same, said("action")), F.when(same & (F.col("want_rule") != "") & (F.col("want_rule") != F.col("rule_id")), said("rule")),
        F.when((F.col("want_reason") != "") & ~F.col("reason").contains(F.col("want_reason")), said("reason")),
    )
    missing = F.transform(F.array_except("want_labels", "labels"), lambda x: said("label", label=x))
    return j.select("id", "case", "step", "action", "rule_id", F.concat(F.filter(found, lambda x: x.isNotNull()), missing).alias("problems"))


def outcomes(checked: DataFrame) -> DataFrame:
    """case, checked, failed of the cases of ``run_cases``."""
    return checked.groupBy("case").agg(F.count("*").alias("checked"), F.count_if(F.size("problems") > 0).alias("failed"))


def recorded(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recorded calls as cases, a session each: (calls, expectations). Against a changed policy they fail on exactly the calls it decides otherwise.

    What no policy decided is left out. Labels are expected only where the result that earned them is known whole.
    """
    own = calls.where(~F.coalesce("rule_id", F.lit("")).isin(*NOT_POLICY))
    whole = ~F.coalesce("result_truncated", F.lit(False)) if "result_truncated" in calls.columns else F.lit(True)
    has = F.col("result_text").isNotNull() & whole if "result_text" in calls.columns else F.lit(False)
    none = F.array().cast("array<string>")
    labels = F.when(has, F.coalesce("labels", none)).otherwise(none) if "labels" in calls.columns else none
    step = F.lit(None).cast("int")
    expected = own.select("id", F.concat(F.lit("session "), "session_id").alias("case"), step.alias("step"), F.col("decision").alias("action"), F.coalesce("rule_id", F.lit("")).alias("rule"), F.lit("").alias("reason"), labels.alias("labels"))
    played = own.withColumns({"decision": F.lit("allow"), "initial_labels": none})
    return played.drop("rule_id", "reason", "labels"), expected


def documents(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """session_id, test: the cases as they are written down, a JSON document a session (which YAML readers read too)."""
    e = F.struct("action", F.nullif(F.col("rule"), F.lit("")).alias("rule"), F.when(F.size("labels") > 0, F.col("labels")).alias("labels"))
    j = calls.drop("labels").join(expected.select("id", "case", e.alias("expect")), "id")
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    result = F.when(F.col("expect.labels").isNotNull() & F.col("result_text").isNotNull(), F.struct(F.col("result_text").alias("text"))) if "result_text" in calls.columns else F.lit(None)
    said = [c for c in ("title", "read_only", "destructive", "idempotent", "open_world") if c in calls.columns]
    hints = F.struct(*said).alias("annotations") if said else F.lit(None).alias("annotations")
    step = F.struct("ts_ms", "id", F.to_json(F.struct("tool", F.try_parse_json("args_json").alias("args"), hints, at.alias("at"), result.alias("result"), "expect")).alias("step"))
    host = F.nullif(F.concat_ws("/", *(F.nullif(F.col(c), F.lit("")) for c in ("host_name", "host_version"))), F.lit("")) if {"host_name", "host_version"} <= set(calls.columns) else F.lit(None).cast("string")
    each = j.groupBy("session_id", "case").agg(F.max(host).alias("host"), F.array_sort(F.collect_list(step)).alias("steps"))
    head = F.to_json(F.struct(F.col("case").alias("name"), "host"))  # an object with its last brace, before which the steps come
    return each.select("session_id", F.concat(F.left(head, F.length(head) - 1), F.lit(',"steps":['), F.array_join(F.transform("steps", lambda s: s["step"]), ","), F.lit("]}")).alias("test"))
