"""The whole decision of a call: special stops, the policy, what is stricter than it, shadow mode.

Decoys, tools held back and canaries stop a call whatever the policy says, in
shadow mode too.  Otherwise the policy decides, and a secret value or a
contract's passage on its way out decides where it is stricter; the kill switch
stays the kill switch.  In shadow mode what would be stopped is recorded and goes
through, except by the kill switch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..detect.secrets import find_canaries
from . import columns
from .columns import strictest
from .model import Policy

# Reasons of the stops.
REASONS = {
    "honeypot": "honeypot: {tool} does not exist. Calling it means the agent is following instructions its operator never gave",
    "quarantine": "this tool is quarantined: {why}. A human has to look at it first",
    "canary": "canary: {name} leaving {how}; it is a fake {kind} credential that nothing legitimate ever sends anywhere, so whatever asked for this is trying to exfiltrate what the agent read",
    "taint": "taint: a value this session read from {source} is leaving {how}",
    "shadow": "shadow mode: would have {verb} ({reason})",
}
VERBS = {"deny": "denied", "ask": "asked"}


@dataclass
class Stops:
    """What stops a call besides the policy. ``canaries``: (id, kind, value); ``taint``: what a tainted value does (deny, ask, warn)."""

    honeypots: Sequence[str] = ()
    canaries: Sequence[tuple[str, str, str]] = ()
    taint: str = "deny"
    kinds: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.kinds = {key: kind for key, kind, _ in self.canaries}


def _filled(reason: str, /, **parts: Column) -> Column:
    import re

    pieces = re.split(r"\{(\w+)\}", REASONS[reason])
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])


def _how(encoding: Column) -> Column:
    return F.when(encoding == "plain", "in plain text").otherwise(F.concat(encoding, F.lit("-encoded")))


def _verdict(action, reason: Column, rule: str) -> Column:
    return F.struct((F.lit(action) if isinstance(action, str) else action).alias("action"), reason.alias("reason"), F.lit(rule).alias("rule_id"), F.lit(0).alias("quorum"))


def gate(calls: DataFrame, p: Policy, stops: Stops | None = None, quarantined: DataFrame | None = None, tainted: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """``calls`` (as ``columns.evaluate`` takes them) with ``verdict``, ``shadow`` and ``goes_through``.

    ``quarantined``: tool, why (one row a tool held back); ``tainted``: id, source, encoding, value (rows of ``flows.tainted_calls``);
    ``flows``: id, action, reason (of ``flows.flow_hits``). The verdict is what the record holds; ``shadow``: it was not applied.
    An ask goes through only if someone allows it, so it does not here.
    """
    stops = stops or Stops()
    v = F.col("verdict")
    judged = columns.evaluate(calls, p)
    extra: list[str] = []

    def join(side: DataFrame | None, on: str, names: dict[str, str]) -> None:
        nonlocal judged
        if side is None:
            judged = judged.withColumns({new: F.lit(None).cast("string") for new in names.values()})
        else:
            key = f"_{on}_of_{len(extra)}"
            judged = judged.join(side.select(F.col(on).alias(key), *(F.col(c).alias(new) for c, new in names.items())), F.col(on) == F.col(key), "left").drop(key)
        extra.extend(names.values())

    join(quarantined, "tool", {"why": "_why"})
    hit = find_canaries(calls.select("id", F.coalesce("args_json", F.lit("")).alias("text")), [(key, value) for key, _, value in stops.canaries]) if stops.canaries else None
    join(hit, "id", {"canary": "_canary", "encoding": "_canary_how"})
    first = None if tainted is None else tainted.groupBy("id").agg(F.min(F.struct("source", "encoding", "value")).alias("t")).select("id", "t.source", "t.encoding")
    join(first, "id", {"source": "_source", "encoding": "_taint_how"})
    join(flows, "id", {"action": "_flow", "reason": "_flow_why"})

    # what is stricter than the policy, in turn; warnings let the call through
    decision = v
    carried = F.lit("allow" if stops.taint == "warn" else stops.taint)
    for test, action, verdict in (
        (F.col("_source").isNotNull(), carried, _verdict(carried, _filled("taint", source=F.col("_source"), how=_how(F.col("_taint_how"))), "taint")),
        (F.col("_flow").isNotNull(), F.col("_flow"), _verdict(F.col("_flow"), F.col("_flow_why"), "flow")),
    ):
        stricter = test & (v["rule_id"] != "frozen") & (strictest(F.array(decision["action"], action)) != decision["action"])
        decision = F.when(stricter, verdict).otherwise(decision)
    shadow = (decision["action"] != "allow") & (decision["rule_id"] != "frozen") if p.mode == "shadow" else F.lit(False)
    # stops that no mode lets through
    kind = F.lit("")
    for key, name in stops.kinds.items():
        kind = F.when(F.col("_canary") == key, name).otherwise(kind)
    hard = F.when(F.col("tool").isin(*stops.honeypots), _verdict("deny", _filled("honeypot", tool=F.col("tool")), "honeypot")) if stops.honeypots else F.when(F.lit(False), v)
    hard = hard.when(F.col("_why").isNotNull(), _verdict("deny", _filled("quarantine", why=F.col("_why")), "quarantine"))
    hard = hard.when(F.col("_canary").isNotNull(), _verdict("deny", _filled("canary", name=F.col("_canary"), how=_how(F.col("_canary_how")), kind=kind), "canary"))
    out = judged.withColumns({"_hard": hard, "_decision": decision}).withColumn("shadow", F.col("_hard").isNull() & shadow)
    out = out.withColumn("verdict", F.coalesce("_hard", "_decision")).drop("_hard", "_decision", *extra)
    return out.withColumn("goes_through", F.col("shadow") | (F.col("verdict.action") == "allow"))


def told(judged: DataFrame) -> Column:
    """What the agent is told of a gated call: the reason, or what shadow mode would have done."""
    verb = F.coalesce(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])[F.col("verdict.action")], F.lit(""))
    return F.when(F.col("shadow"), _filled("shadow", verb=verb, reason=F.col("verdict.reason"))).otherwise(F.col("verdict.reason"))
