"""Policies as columns: every condition becomes a boolean expression of Catalyst.

A call is a row with ``tool``, ``upstream``, ``tool_name``, ``args_json`` and, where
there are any, ``ts_ms``, ``host_name``, ``host_version``, ``frozen``, ``read_only``,
``destructive``, ``idempotent``, ``open_world``, ``title``, ``session_labels``,
``session_called``, ``session_calls``, ``tool_calls``, ``last_minute``, ``repeats``,
``tokens``, ``spent``, ``spent_today``, ``result_is_error``, ``result_text``.
Columns a call lacks are missing values; missing makes a condition false
(``exists`` and ``excludes`` aside).

Arguments are navigated as VARIANT: a selector gives an array of values, and a
condition holds if any of them matches, as the language wants it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import name_pattern, re2_to_java
from .model import REASONS, Condition, Policy

DEFAULTS = {
    "args_json": "string", "ts_ms": "bigint", "host_name": "string", "host_version": "string", "frozen": "boolean", "read_only": "boolean", "destructive": "boolean",
    "idempotent": "boolean", "open_world": "boolean", "title": "string", "session_labels": "array<string>", "session_called": "array<string>", "session_calls": "bigint",
    "tool_calls": "bigint", "last_minute": "bigint", "repeats": "bigint", "tokens": "bigint", "spent": "double", "spent_today": "double", "result_is_error": "boolean", "result_text": "string",
}


def prepared(calls: DataFrame) -> DataFrame:
    """``calls`` with every column a policy may look at, and the parsed arguments as ``_args``."""
    add = {c: F.lit(None).cast(t) for c, t in DEFAULTS.items() if c not in calls.columns}
    out = calls.withColumns(add) if add else calls
    return out.withColumn("_args", F.try_parse_json(F.coalesce(F.nullif("args_json", F.lit("")), F.lit("{}"))))


# --- values ---------------------------------------------------------------------

_STEP = re.compile(r"\.?([^.\[\]{}]+)|\[(-?\d+|\*)\]|\.?\{([^}]*)\}")


def parse_path(rest: str) -> list[tuple[str, object]]:
    """``.key``, ``[n]``, ``[*]`` and ``{a,b}`` steps."""
    out, at = [], 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise ValueError(f"selector: {rest!r}")
        if m[1] is not None:
            out.append(("key", m[1]))
        elif m[2] is not None:
            out.append(("each", None) if m[2] == "*" else ("index", int(m[2])))
        else:
            out.append(("any", [k.strip() for k in m[3].split(",")]))
        at = m.end()
    return out


def _get(x: Column, key: str) -> Column:
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(x, f"$['{escaped}']", "variant")


def _flat(values: Column, f) -> Column:
    """The values that f gives for each, those missing left out."""
    return F.filter(F.transform(values, f), lambda x: x.isNotNull())


def _items(x: Column) -> Column:
    return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))


def selected(path: str) -> tuple[Column, str]:
    """The values of a selector and their kind: variant, string, boolean or number arrays."""
    root, _, rest = path.partition(".") if not path.startswith("args[") else ("args", "", path[4:])
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    if root == "args":
        values = F.filter(F.array("_args"), lambda x: x.isNotNull())
        for kind, arg in parse_path(rest):
            if kind == "key":
                values = _flat(values, _getter(arg))
            elif kind == "any":
                values = F.filter(F.flatten(F.transform(values, _alternatives(arg))), lambda x: x.isNotNull())
            elif kind == "each":
                values = F.flatten(F.transform(values, _items))
            else:
                values = _flat(values, _indexer(arg))
        return values, "variant"
    if root in ("tool", "tool_name", "upstream"):
        return one(F.col(root)), "string"
    if root == "annotations":
        return one(F.col(rest)), "string" if rest == "title" else "boolean"
    if root == "time":
        ts = F.timestamp_millis("ts_ms")
        if rest == "weekday":
            return one(F.lower(F.date_format(ts, "EEEE"))), "string"
        return one((F.hour(ts) if rest == "hour" else F.minute(ts)).cast("double")), "number"
    if root == "host":
        return one(F.nullif(F.col(f"host_{rest}"), F.lit(""))), "string"
    if root == "session":
        if rest == "calls":
            return F.array(F.coalesce("session_calls", F.lit(0)).cast("double")), "number"
        if rest.startswith("label."):
            return F.array(F.coalesce(F.array_contains("session_labels", rest[6:]), F.lit(False))), "boolean"
        return F.coalesce(F.col("session_labels" if rest == "labels" else "session_called"), none), "list"
    if root == "result":
        return (one(F.col("result_is_error")), "boolean") if rest == "is_error" else (one(F.col("result_text")), "string")
    raise ValueError(f"selector: {path!r}")


def _getter(key):
    return lambda x: _get(x, key)


def _alternatives(keys):
    return lambda x: F.array(*[_get(x, k) for k in keys])


def _indexer(n):
    def get(x):
        items = _items(x)
        at = n if n >= 0 else F.size(items) + n
        return F.get(items, F.lit(at) if n >= 0 else at)

    return get


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _type(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def as_text(v: Column, kind: str) -> Column:
    return v.cast("string") if kind != "variant" else F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("null"))


def equal_to(v: Column, kind: str, want) -> Column:
    """JSON equality: numbers by value, strings exactly, never across types."""
    if isinstance(want, bool):
        if kind == "boolean":
            return v == F.lit(want)
        return (_type(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == want) if kind == "variant" else F.lit(False)
    if isinstance(want, (int, float)):
        if kind == "number":
            return v == float(want)
        return _is_number(v) & (F.try_variant_get(v, "$", "double") == float(want)) if kind == "variant" else F.lit(False)
    if isinstance(want, str):
        if kind in ("string", "list"):
            return v == want
        return (_type(v) == "STRING") & (F.try_variant_get(v, "$", "string") == want) if kind == "variant" else F.lit(False)
    if want is None:
        return _type(v) == "VOID" if kind == "variant" else F.lit(False)
    import json

    return F.to_json(v) == json.dumps(want, separators=(",", ":"), sort_keys=True) if kind == "variant" else F.lit(False)


def shell_view(text: Column) -> Column:
    """A command as the shell reads it: IFS is a blank, quotes and escapes go, blanks collapse."""
    t = F.regexp_replace(text, r"\$\{?IFS\}?", " ")
    t = F.regexp_replace(t, r"\\(?:\n|([\s\S])|\z)|['\"]", "$1")
    return F.regexp_replace(t, r"[ \t]+", " ")


def sql_view(text: Column) -> Column:
    """A statement without comments, blanks collapsed."""
    t = F.regexp_replace(text, r"(?s)/\*.*?(?:\*/|\z)|--[^\n]*", " ")
    return F.trim(F.regexp_replace(t, r"[\t\n\f\r ]+", " "))


def clean(path: Column) -> Column:
    """The lexically shortest form of a path, by a stack folded over its parts."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    rooted = F.substring(F.translate(path, "\\", "/"), 1, 1) == "/"

    def push(acc, p):
        up = p == ".."
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up & can_pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", ".") | (up & rooted), acc).otherwise(F.concat(acc, F.array(p)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/")
    return F.when(rooted, F.concat(F.lit("/"), folded)).otherwise(F.when(folded == "", ".").otherwise(folded))


def under(path: Column, root: str) -> Column:
    from .model import clean_path

    base = clean_path(root)
    p = clean(path)
    return (p == base) | p.startswith(base if base.endswith("/") else base + "/")


def matches_one(v: Column, kind: str, matcher: dict) -> Column:
    """Does one value meet a matcher?"""
    if set(matcher) <= {"gt", "lt"}:
        number = F.try_variant_get(v, "$", "double") if kind == "variant" else v.cast("double")
        ok = _is_number(v) if kind == "variant" else F.lit(kind == "number")
        if "gt" in matcher:
            ok = ok & (number > float(matcher["gt"]))
        return ok & (number < float(matcher["lt"])) if "lt" in matcher else ok
    name, want = next(iter(matcher.items()))
    negative, base = name.startswith("not_"), name.removeprefix("not_")
    if base == "equals":
        hit = equal_to(v, kind, want)
    elif base == "in":
        hit = F.lit(False)
        for w in want:
            hit = hit | equal_to(v, kind, w)
    else:
        text = as_text(v, kind)
        if base == "prefix":
            hit = text.startswith(want)
        elif base == "path_prefix":
            hit = under(text, want)
        else:
            view = {"regex": lambda t: t, "shell_regex": shell_view, "sql_regex": sql_view}[base]
            hit = view(text).rlike(re2_to_java(want))
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if negative else hit


def holds(c: Condition) -> Column:
    """Does a condition hold for the row?"""
    values, kind = selected(c.path)
    name, want = next(iter(c.matcher.items()))
    if name == "exists":
        return (F.size(values) > 0) == F.lit(bool(want))
    if name in ("includes", "excludes"):
        if kind == "variant":
            inside = F.flatten(F.transform(values, lambda x: F.when(_type(x).startswith("ARRAY"), _items(x)).otherwise(F.array(x))))
            hit = F.exists(inside, lambda x: equal_to(x, "variant", want))
        else:
            hit = F.exists(values, lambda x: equal_to(x, kind, want))
        hit = F.coalesce(hit, F.lit(False))
        return hit if name == "includes" else ~hit
    return F.coalesce(F.exists(values, lambda x: matches_one(x, kind, c.matcher)), F.lit(False))


def tool_matches(pattern: str) -> Column:
    if pattern in ("", "*"):
        return F.lit(True)
    p = name_pattern(pattern)
    return F.col("tool").rlike(p) | F.concat_ws(".", "upstream", "tool_name").rlike(p)


def matches(entry) -> Column:
    """A rule or label rule as a column: the tool first, it is cheap."""
    out = tool_matches(entry.tool)
    for c in entry.when:
        out = out & holds(c)
    return out


# --- decisions -------------------------------------------------------------------


def _decision(action: str, reason, rule_id: str, quorum: int = 0) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"), F.lit(rule_id).alias("rule_id"), F.lit(quorum).alias("quorum"))


def _reason(name: str, **parts) -> Column:
    """A reason with its parts, texts or columns."""
    pieces = re.split(r"\{(\w+)\}", REASONS[name])
    value = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    return F.concat(*[value(parts[x]) if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])


def hard_stops(p: Policy) -> list[tuple[Column, Column]]:
    """(condition, decision) of freeze, loop guard and budgets, in order."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    stop = lambda rule, name, **parts: _decision("deny", _reason(name, **parts), rule)
    out = [(F.coalesce("frozen", F.lit(False)), stop("frozen", "frozen"))]
    if p.repeats > 0:
        out.append((n("repeats") >= p.repeats, stop("loop-guard", "loop-guard", n=n("repeats").cast("string"))))
    for name, so_far in (("calls_per_session", "session_calls"), ("calls_per_minute", "last_minute"), ("tokens_per_session", "tokens")):
        if (limit := getattr(p, name)) > 0:
            out.append((n(so_far) >= limit, stop("budget", name, n=limit)))
    dotted = F.concat_ws(".", "upstream", "tool_name")
    for key, limit in p.calls_per_tool.items():
        if limit > 0:
            hit = (F.col("tool") == key) | ((dotted == key) & ~F.col("tool").isin(*p.calls_per_tool))
            out.append((hit & (n("tool_calls") >= limit), stop("budget", "calls_per_tool", n=limit, tool=key)))
    for what, spent, cap in (("session", "spent", p.money.get("per_session", 0)), ("daily", "spent_today", p.money.get("per_day", 0))):
        if cap > 0:
            price = call_price(p)
            so_far = F.coalesce(F.col(spent), F.lit(0.0))
            money = lambda c: F.concat(F.format_string("%.2f ", c), F.lit(p.money.get("currency", "EUR")))
            out.append((so_far >= cap, stop("budget", "spent", what=what, limit=money(F.lit(float(cap))))))
            out.append(((price > 0) & (so_far + price > cap + 1e-9), stop("budget", "too dear", price=money(price), left=money(cap - so_far), what=what)))
    return out


def call_price(p: Policy) -> Column:
    out = F.lit(0.0)
    for pattern, amount in sorted((p.money.get("prices") or {}).items(), reverse=True):
        out = F.when(tool_matches(pattern), float(amount)).otherwise(out)
    return out


def decision(p: Policy) -> Column:
    """First match wins: hard stops, rules in order, the default."""
    branches = hard_stops(p) + [(matches(r), _decision(r.action, r.text(), r.id, r.quorum)) for r in p.rules]
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    default = _decision(p.default, _reason("default", action=p.default), "")
    return out.otherwise(default) if out is not None else default


def evaluate(calls: DataFrame, p: Policy) -> DataFrame:
    """``calls`` with ``verdict``: struct of action, reason, rule_id, quorum."""
    return prepared(calls).withColumn("verdict", decision(p)).drop("_args", *[c for c in DEFAULTS if c not in calls.columns])


def labels_earned(p: Policy) -> Column:
    """The labels a forwarded call earns, in the order of the rules, each once."""
    hits = F.array(*[F.when(matches(x), F.lit(x.label)) for x in p.labels]) if p.labels else F.array().cast("array<string>")
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def strictest(actions: Column) -> Column:
    """Of an array of actions the strictest: deny, ask, allow."""
    rank = lambda a: F.when(a == "deny", 2).when(a == "ask", 1).otherwise(0)
    return F.element_at(F.array(F.lit("allow"), F.lit("ask"), F.lit("deny")), F.array_max(F.transform(actions, rank)) + 1)
