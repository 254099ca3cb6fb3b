"""Session fold, replay under a policy, alignment of two sessions.

What a rule can tell from the call alone is computed in Catalyst for all calls at
once; only what depends on earlier decisions (budgets, labels, called tools) is
folded, session by session, in one ordered pass that holds the state of one
session.  Policies without such conditions skip the fold.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import compiled
from ..operators.alignment import align
from . import columns
from .model import REASONS, Condition, Policy

MINUTE_MS = 60_000
STATE_PATHS = ("session.calls", "session.labels", "session.called", "session.label.")


def is_stateful(c: Condition) -> bool:
    return c.path.startswith(STATE_PATHS)


def needs_fold(p: Policy) -> bool:
    budgets = p.calls_per_session or p.calls_per_minute or p.tokens_per_session or p.calls_per_tool or p.repeats or p.labels
    return bool(budgets) or any(is_stateful(c) for r in p.rules for c in r.when)


class Session:
    """State of a session between two calls."""

    def __init__(self):
        self.calls, self.tokens, self.streak, self.signature = 0, 0, 0, None
        self.per_tool: dict[str, int] = {}
        self.recent: deque[int] = deque()
        self.labels: set[str] = set()
        self.called: set[str] = set()

    def observe(self, signature: str, at_ms: int) -> int:
        """Repeats right before this call, itself not counted; denied calls count too."""
        repeats = self.streak if signature == self.signature else 0
        self.streak, self.signature = repeats + 1, signature
        while self.recent and self.recent[0] <= at_ms - MINUTE_MS:
            self.recent.popleft()
        return repeats

    def forward(self, tool: str, names: list[str], tokens: int, at_ms: int) -> None:
        self.calls += 1
        self.tokens += tokens
        self.per_tool[tool] = self.per_tool.get(tool, 0) + 1
        self.recent.append(at_ms)
        self.called.update(names)

    def holds(self, c: Condition) -> bool:
        """A condition on the session's own past."""
        name, want = next(iter(c.matcher.items()))
        if c.path == "session.calls":
            values: list = [self.calls]
        elif c.path.startswith("session.label."):
            values = [c.path[14:] in self.labels]
        else:
            values = sorted(self.labels if c.path == "session.labels" else self.called)
        same = lambda v, w: v == w and isinstance(v, bool) == isinstance(w, bool) and isinstance(v, str) == isinstance(w, str)
        if name == "exists":
            return bool(values) == want
        if name in ("includes", "excludes"):
            return any(same(v, want) for v in values) == (name == "includes")
        if set(c.matcher) <= {"gt", "lt"}:
            return any(not isinstance(v, (bool, str)) and v > c.matcher.get("gt", float("-inf")) and v < c.matcher.get("lt", float("inf")) for v in values)
        tests = {
            "equals": lambda v: same(v, want), "in": lambda v: any(same(v, w) for w in want),
            "prefix": lambda v: str(v).startswith(want), "regex": lambda v: compiled(want).search(str(v)) is not None,
        }
        base = name.removeprefix("not_")
        return any(tests[base](v) != name.startswith("not_") for v in values)


def decide(p: Policy, s: Session, tool: str, names: list[str], repeats: int, ok: list[bool], frozen: bool) -> tuple[str, str, str]:
    """(action, rule, reason); ``ok``: of each rule, do its stateless conditions hold."""
    if frozen:
        return "deny", "frozen", REASONS["frozen"]
    if p.repeats and repeats >= p.repeats:
        return "deny", "loop-guard", REASONS["loop-guard"].format(n=repeats)
    for name, so_far in (("calls_per_session", s.calls), ("calls_per_minute", len(s.recent)), ("tokens_per_session", s.tokens)):
        limit = getattr(p, name)
        if limit and so_far >= limit:
            return "deny", "budget", REASONS[name].format(n=limit)
    key = next((n for n in names if n in p.calls_per_tool), None)
    if key and p.calls_per_tool[key] and s.per_tool.get(tool, 0) >= p.calls_per_tool[key]:
        return "deny", "budget", REASONS["calls_per_tool"].format(n=p.calls_per_tool[key], tool=key)
    for i, r in enumerate(p.rules):
        if ok[i] and all(s.holds(c) for c in r.when if is_stateful(c)):
            return r.action, r.id, r.text()
    return p.default, "", REASONS["default"].format(action=p.default)


REPLAYED = "id string, session_id string, was string, action string, rule_id string, reason string, changed boolean, labels array<string>, session_calls long, tokens long"


def replay(calls: DataFrame, p: Policy) -> DataFrame:
    """Recorded calls (id, session_id, ts_ms, tool, upstream, tool_name, args_json, args_hash, tokens_est, decision, ...) under a policy.

    A call goes through if it is allowed, or asked for and was allowed then; only
    those change the state. ``labels`` are the session's after the call; a session begins with the ``initial_labels`` of its first call. Spending
    is not simulated.
    """
    c = columns.prepared(calls)
    static = lambda e: columns.matches(type(e)(**{**e.__dict__, "when": [x for x in e.when if not is_stateful(x)]}))
    rules = F.array(*[static(r) for r in p.rules]) if p.rules else F.array().cast("array<boolean>")
    labels = F.array(*[static(x) for x in p.labels]) if p.labels else F.array().cast("array<boolean>")
    rows = c.select("id", "session_id", "ts_ms", "tool", F.concat_ws(".", "upstream", "tool_name").alias("dotted"), F.concat_ws("\x00", "tool", "args_hash").alias("sig"), "tokens_est", "decision", F.coalesce("frozen", F.lit(False)).alias("frozen"), rules.alias("rules"), labels.alias("label_rules"), (F.col("initial_labels") if "initial_labels" in calls.columns else F.lit(None).cast("array<string>")).alias("initial"))
    if not needs_fold(p) and "initial_labels" not in calls.columns:
        out = columns.evaluate(calls, p)
        v = F.col("verdict")
        none = F.array().cast("array<string>")
        return out.select("id", "session_id", F.col("decision").alias("was"), v["action"].alias("action"), v["rule_id"].alias("rule_id"), v["reason"].alias("reason"), (v["action"] != F.col("decision")).alias("changed"), none.alias("labels"), F.lit(None).cast("long").alias("session_calls"), F.lit(None).cast("long").alias("tokens"))
    names = [x.split()[0] for x in REPLAYED.split(", ")]

    def run(batches):
        key, s = None, Session()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["session_id"] != key:
                    key, s = r["session_id"], Session()
                    s.labels.update(r["initial"] or ())
                both = [r["tool"]] + ([r["dotted"]] if r["dotted"] != r["tool"] else [])
                repeats = s.observe(r["sig"], r["ts_ms"])
                action, rule, reason = decide(p, s, r["tool"], both, repeats, r["rules"], r["frozen"])
                if action == "allow" or (action == "ask" and r["decision"] == "allow"):
                    # labels look at the session as it was before the call joins it
                    earned = [x.label for x, ok in zip(p.labels, r["label_rules"]) if ok and all(s.holds(c) for c in x.when if is_stateful(c))]
                    s.forward(r["tool"], both, r["tokens_est"] or 0, r["ts_ms"])
                    s.labels.update(earned)
                out.append((r["id"], key, r["decision"], action, rule, reason, action != r["decision"], sorted(s.labels), s.calls, s.tokens))
            if out:
                kinds = (pa.string(),) * 6 + (pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "id").mapInArrow(run, REPLAYED)


def replay_counts(replayed: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return replayed.agg(n(F.col("action") == "allow", "allowed"), n(F.col("action") != "allow", "not_allowed"), n(F.col("changed"), "changed"))


DIFFED = "pair string, position int, status string, a_id string, b_id string, tool string"


def diff(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs``: pair, a, b (session ids) -> their calls aligned on tool names.

    status: same, decision, args, result (what differs first), only-a, only-b. Of a pair the calls' few columns and
    ``align``'s rows are held, not a table of their product.
    """
    c = calls.select("session_id", "ts_ms", "id", "tool", "args_hash", "decision", *([F.col("result_hash")] if "result_hash" in calls.columns else [F.lit("").alias("result_hash")]))
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("session_id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("session_id")))).alias("s")).select("pair", "s.*")

    def run(key, both):
        import pandas as pd

        l, r = (both[both["side"] == s].sort_values(["ts_ms", "id"]).to_dict("records") for s in "ab")
        out = []
        for n, (i, j) in enumerate(align([x["tool"] for x in l], [x["tool"] for x in r])):
            p, q = l[i] if i is not None else None, r[j] if j is not None else None
            status = "only-b" if p is None else "only-a" if q is None else "decision" if p["decision"] != q["decision"] else "args" if p["args_hash"] != q["args_hash"] else "result" if p["result_hash"] != q["result_hash"] and p["result_hash"] and q["result_hash"] else "same"
            out.append((key[0], n, status, p and p["id"], q and q["id"], (p or q)["tool"]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in DIFFED.split(", ")])

    return sides.join(c, "session_id").groupBy("pair").applyInPandas(run, DIFFED)
