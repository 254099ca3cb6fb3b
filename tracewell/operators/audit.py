"""Relational queries over ``calls`` and ``sessions`` (columns as in ``tracewell.sources``).

Every function is DataFrames -> DataFrame.  Times are epoch milliseconds.
Rows that were held back only on paper (``shadow``) went through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def went_through() -> Column:
    """Did the call reach its server?"""
    return (F.col("decision") == "allow") | F.col("shadow")


def blocked() -> Column:
    return ~went_through()


def _count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def session_list(sessions: DataFrame, calls: DataFrame, since_ms: int | None = None, limit: int | None = 200) -> DataFrame:
    """Newest first, with each session's calls and denials (shadow denials count here)."""
    n = calls.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("calls"), _count_if(F.col("decision") == "deny", "denied"))
    s = sessions if since_ms is None else sessions.where(F.col("started_ms") >= since_ms)
    out = s.join(n, "id", "left").fillna(0, ["calls", "denied"]).orderBy(F.desc("started_ms"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def session_by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session of this id, else those it is a prefix of (at most two: two mean ambiguous)."""
    found = sessions.where(F.col("id").startswith(prefix)).withColumn("exact", F.col("id") == prefix)
    return found.orderBy(F.desc("exact"), "id").limit(2).withColumn("any_exact", F.max("exact").over(_one())).where("exact OR NOT any_exact").drop("exact", "any_exact")


def _one():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def call_filter(calls: DataFrame, session: str | None = None, decision: str | None = None, tool: str | None = None, after_id: str | None = None, since_ms: int | None = None, rule: str | None = None, after_seq: int | None = None, newest: bool = False, limit: int | None = 5000) -> DataFrame:
    """Calls that meet all conditions; ``tool`` is a substring, ASCII letters alike. Order: by seq after a seq, newest first, or by time."""
    tests = {"session_id": session, "decision": decision, "rule_id": rule}
    out = calls
    for c, v in tests.items():
        out = out if v is None else out.where(F.col(c) == v)
    if tool is not None:
        lower = str.maketrans(UPPER, LOWER)  # letters beyond ASCII keep their case
        out = out.where(F.translate("tool", UPPER, LOWER).contains(tool.translate(lower)))
    if after_id is not None:
        out = out.where(F.col("id") > after_id)
    if since_ms is not None:
        out = out.where(F.col("ts_ms") >= since_ms)
    if after_seq is not None:
        out = out.where(F.col("seq") > after_seq)
    order = [F.col("seq")] if after_seq is not None else [F.desc("ts_ms"), F.desc("id")] if newest else [F.col("ts_ms"), F.col("id")]
    out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def forwarded(calls: DataFrame, since_ms: int = 0) -> DataFrame:
    """What reached a server since then: four columns, for billing."""
    return calls.where((F.col("ts_ms") >= since_ms) & went_through()).select("ts_ms", "tool", "tokens_est", "session_id")


def global_stats(sessions: DataFrame, calls: DataFrame, since_ms: int = 0) -> DataFrame:
    """One row of counters, in one pass over the calls."""
    c = calls.where(F.col("ts_ms") >= since_ms).agg(
        F.count("*").alias("calls"), _count_if((F.col("decision") == "deny") & ~F.col("shadow"), "denied"), _count_if(F.col("shadow"), "shadowed"),
        *[_count_if(F.col("rule_id") == r, r) for r in ("honeypot", "canary", "quarantine")],
        _count_if(F.col("is_error") & (F.col("decision") == "allow"), "errors"), F.coalesce(F.sum("tokens_est"), F.lit(0)).alias("tokens"),
    )
    s = sessions.where(F.col("started_ms") >= since_ms).agg(F.count("*").alias("sessions"))
    return s.join(c)  # one row each


def tool_stats(calls: DataFrame, since_ms: int = 0) -> DataFrame:
    """Per tool, most used first."""
    return calls.where(F.col("ts_ms") >= since_ms).groupBy("tool").agg(
        F.max("upstream").alias("upstream"), F.count("*").alias("calls"), _count_if(went_through(), "allowed"),
        _count_if((F.col("decision") == "deny") & ~F.col("shadow"), "denied"), _count_if(F.col("decision") == "ask", "asked"),
        _count_if(F.col("is_error"), "errors"), F.round(F.avg(F.when(F.col("decision") == "allow", F.col("duration_ms"))), 6).alias("avg_ms"),
        F.sum("tokens_est").alias("tokens"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
    ).orderBy(F.desc("calls"), "tool")


def rule_stats(calls: DataFrame) -> DataFrame:
    return calls.where("rule_id <> ''").groupBy("rule_id", "decision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id", "decision")


def label_sessions(calls: DataFrame) -> DataFrame:
    """label, session_id of each session that earned it, with the label's number of sessions: rows, not one list a label."""
    pairs = calls.select(F.explode("labels").alias("label"), "session_id").distinct()
    return pairs.join(pairs.groupBy("label").agg(F.count("*").alias("n_sessions")), "label")


def decision_class(calls: DataFrame) -> DataFrame:
    """shadow > deny > error > allow."""
    kind = F.when(F.col("shadow"), "shadow").when(F.col("decision") == "deny", "deny").when(F.col("is_error"), "error").otherwise("allow")
    return calls.select("id", kind.alias("class"))


def tail_badges(calls: DataFrame) -> DataFrame:
    """The one word a live view shows: special rules first, then flags."""
    rule = F.col("rule_id")
    badge = F.when(rule == "honeypot", "TRAP").when(rule == "canary", "CANARY").when(rule == "quarantine", "HELD").when(F.col("shadow"), "SHADOW")
    badge = badge.when(F.col("decision") == "deny", "DENY").when(F.col("decision") == "ask", "ASK").when(F.col("is_error"), "ERROR").otherwise("allow")
    return calls.select("id", badge.alias("badge"))


# --- thresholds ---------------------------------------------------------------

COUNTERS = ("sessions", "calls", "denied", "shadowed", "honeypot", "canary", "quarantine", "errors", "tokens")
OPS = {">=": Column.__ge__, "<=": Column.__le__, "!=": Column.__ne__, "==": Column.__eq__, ">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__}


def parse_thresholds(spec: str) -> list[tuple[str, str, int]]:
    """``canary>0, rule:x>=2`` -> [(counter, op, number)]; ValueError for anything else."""
    import re

    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(rule:[^<>=!]+?|[a-z]+)\s*(>=|<=|==|!=|>|<|=)\s*(\d+)", part)
        if not m or (not m[1].startswith("rule:") and m[1] not in COUNTERS):
            raise ValueError(f"threshold {part!r}: a counter ({', '.join(COUNTERS)} or rule:<id>), an operator and a number")
        out.append((m[1], m[2], int(m[3])))
    return out


def crossed(stats: DataFrame, rules: DataFrame, spec: str) -> DataFrame:
    """The conditions that hold, one row each: condition, value."""
    tests = parse_thresholds(spec)
    by_rule = rules.groupBy("rule_id").agg(F.sum("n").alias("n"))
    ids = [c.removeprefix("rule:") for c, _, _ in tests if c.startswith("rule:")]
    wanted = by_rule.where(F.col("rule_id").isin(ids)).agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "n"))).alias("by_rule"))
    row = stats.join(wanted)  # one row each
    value = lambda c: F.coalesce(F.try_element_at("by_rule", F.lit(c.removeprefix("rule:"))), F.lit(0)).cast("long") if c.startswith("rule:") else F.col(c).cast("long")
    hits = F.array(*[F.when(OPS[op](value(c), n), F.struct(F.lit(f"{c} {op} {n}").alias("condition"), value(c).alias("value"))) for c, op, n in tests])
    return row.select(F.inline(F.filter(hits, lambda h: h.isNotNull())))


# --- retention ------------------------------------------------------------------


def retention_last(calls: DataFrame, cut_ms: int) -> DataFrame:
    """The last link that may go: only a prefix of the chain is cut, up to the first call to keep."""
    first = F.min(F.when(F.col("ts_ms") >= cut_ms, F.col("seq")))
    return calls.agg(F.coalesce(first - 1, F.max("seq")).alias("last_seq"))


def retain_calls(calls: DataFrame, cut_ms: int) -> DataFrame:
    last = retention_last(calls, cut_ms)
    kept = calls.join(last).where(F.when(F.col("seq").isNotNull(), ~(F.col("seq") <= F.col("last_seq")) | F.col("last_seq").isNull()).otherwise(F.col("ts_ms") >= cut_ms))
    return kept.drop("last_seq")


def retain_sessions(sessions: DataFrame, kept_calls: DataFrame, cut_ms: int) -> DataFrame:
    """Sessions that are recent or still have calls."""
    old = sessions.where(F.coalesce("ended_ms", "started_ms") < cut_ms).join(kept_calls.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    return sessions.join(old.select("id"), "id", "left_anti")


def retain_catalogs(catalogs: DataFrame, kept_sessions: DataFrame, kept_calls: DataFrame, cut_ms: int) -> DataFrame:
    """Catalogs that are recent or that a session or call that stays was made under."""
    used = kept_sessions.select(F.col("catalog_hash").alias("hash")).union(kept_calls.select("catalog_hash")).where("hash IS NOT NULL").distinct()
    old = catalogs.where(F.col("created_ms") < cut_ms).join(used, "hash", "left_anti")
    return catalogs.join(old.select("hash"), "hash", "left_anti")


def orphan_calls(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    return calls.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")


# --- money ------------------------------------------------------------------------


def cost(prices: list[tuple[str, float]], per_million_tokens: float = 0.0) -> Column:
    """A call's price (the first pattern, in name order, that its tool matches) plus its tokens'."""
    from ..functions.regexes import glob_to_java

    price = F.lit(0.0)
    for pattern, amount in sorted(prices, reverse=True):
        price = F.when(F.col("tool").rlike(glob_to_java(pattern)), F.lit(float(amount))).otherwise(price)
    return price + F.col("tokens_est") * per_million_tokens / 1e6


def bill(calls: DataFrame, prices, per_million_tokens: float, start_ms: int, end_ms: int) -> DataFrame:
    """Calls, tokens and cost by day, by tool and in total, as grouping sets of one pass; ``grouping`` (day, tool, total) tells a tool without a name from all tools."""
    c = calls.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms) & went_through())
    c = c.select(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), "tool", "tokens_est", cost(prices, per_million_tokens).alias("cost"))
    out = c.groupingSets([["day"], ["tool"], []], "day", "tool").agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), F.sum("tokens_est").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return out.select(F.when(F.col("level") == 1, "day").when(F.col("level") == 2, "tool").otherwise("total").alias("grouping"), F.coalesce("day", F.lit("")).alias("day"), F.coalesce("tool", F.lit("")).alias("tool"), "calls", "tokens", "cost")


# --- reports ----------------------------------------------------------------------


def session_report(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """A session's numbers: asked counts what a person answered, the end is the last moment anything ended."""
    asked = F.col("reason").contains("approved by") | F.col("reason").contains("rejected by")
    n = calls.groupBy(F.col("session_id").alias("id")).agg(
        _count_if(F.col("shadow"), "shadowed"), _count_if((F.col("decision") == "deny") & ~F.col("shadow"), "denied"), _count_if(F.col("decision") == "allow", "allowed"),
        _count_if(asked, "asked"), _count_if(F.col("is_error"), "errors"), F.sum("tokens_est").alias("tokens"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))), ",").alias("labels"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max(F.col("ts_ms") + F.col("duration_ms")).alias("last_ms"),
    )
    out = sessions.join(n, "id")
    return out.withColumn("end_ms", F.greatest("started_ms", F.coalesce("ended_ms", "started_ms"), "last_ms")).drop("last_ms", "ended_ms", "host_name")


def session_tools(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "tool").agg(F.count("*").alias("calls"), _count_if((F.col("decision") == "deny") & ~F.col("shadow"), "denied"), _count_if(F.col("is_error"), "errors"), F.sum("duration_ms").alias("total_ms"))


def timeline(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call's place on a bar of 0 to 1000 between its session's first and last moment."""
    s = calls.groupBy("session_id").agg(F.min("ts_ms").alias("a"), F.max(F.col("ts_ms") + F.col("duration_ms")).alias("b"))
    span = (F.col("b") - F.col("a")).cast("double")
    x = F.when(span > 0, F.least(F.greatest((F.col("ts_ms") - F.col("a")) / span * 1000, F.lit(0.0)), F.lit(1000.0))).otherwise(0.0)
    sec = F.floor((F.col("ts_ms") - F.col("a")) / 1000)
    offset = F.format_string("+%02d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60)
    return calls.join(s, "session_id").select("id", F.round(x, 6).alias("x"), offset.alias("offset"))


def round_up(n: Column) -> Column:
    """10, then the next ten, then the next hundred."""
    return F.when(n <= 10, 10).when(n <= 100, F.ceil(n / 10) * 10).otherwise(F.ceil(n / 100) * 100).cast("long")


def suggest(calls: DataFrame) -> DataFrame:
    """A policy fitting what was seen: per tool allow or deny, and a budget of twice the busiest session."""
    busiest = calls.groupBy("session_id").count().agg(F.max("count").alias("most"))
    t = calls.groupBy("tool").agg(_count_if(went_through(), "allowed"), F.count("*").alias("calls"), F.max(F.col("rule_id") == "honeypot").alias("trap"))
    action = F.when(F.col("trap"), "honeypot").when(F.col("allowed") > 0, "allow").otherwise("deny")
    return t.join(busiest).select("tool", "calls", action.alias("action"), round_up(F.col("most") * 2).alias("calls_per_session"))


def classify(attacks: DataFrame) -> DataFrame:
    """``attacks``: attack, caught booleans -> one row of detection and false-alarm rates."""
    n = attacks.agg(_count_if(F.col("attack"), "attacks"), _count_if(~F.col("attack"), "benign"), _count_if(F.col("attack") & F.col("caught"), "caught"), _count_if(~F.col("attack") & F.col("caught"), "false_alarms"))
    rate = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return n.withColumn("detection", rate("caught", "attacks")).withColumn("false_alarm_rate", rate("false_alarms", "benign"))


def missed(attacks: DataFrame) -> DataFrame:
    """``attacks``: id, attack, caught booleans -> id, outcome (missed or false alarm) of the rows a detector got wrong."""
    return attacks.where(F.col("attack") != F.col("caught")).select("id", F.when(F.col("attack"), "missed").otherwise("false alarm").alias("outcome"))


def live_sessions(sessions: DataFrame, calls: DataFrame, now_ms: int, most: int = 50, within_ms: int = 86_400_000) -> DataFrame:
    """Of the ``most`` newest sessions of the last day those still open, with their calls and labels; one that never ended leaves after a day."""
    recent = sessions.where(F.col("started_ms") >= now_ms - within_ms).orderBy(F.desc("started_ms"), F.desc("id")).limit(most).where("ended_ms IS NULL")
    own = calls.join(recent.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    n = own.groupBy("session_id").agg(F.count("*").alias("calls"))
    each = own.select("session_id", F.explode("labels").alias("label")).distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    out = recent.join(n.join(each, "session_id", "left"), recent["id"] == F.col("session_id"), "left")
    return out.select("id", "started_ms", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
