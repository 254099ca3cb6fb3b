"""Where data goes within a session: secret values on their way out, and contracts about what may reach which tool.

Both compare what a session read with what it sends later, and neither pairs
calls with calls.  Secret values become needles (every encoding of each); a
session's needles meet its outgoing texts in chunks, where one automaton finds
all needles in one pass over a text.  Contracts compare fingerprints: of each
fingerprint a session read under a contract the first place counts, so a sent
fingerprint meets one row at most, however often it was read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import glob_to_java
from ..policy.columns import strictest
from .secrets import MIN_LENGTH, encodings, printed, secret_values

# Of a session's secret values and of a contract's fingerprints so many, the first read, are kept.
MOST_VALUES, MOST_PRINTS = 1000, 200_000
# Fixed value: the reason of a contract that gives none.
REASON = "flow {id}: data read from {source} may not go to {sink}"
#: Values of a session that one automaton holds, and bytes of outgoing text that one task looks through at once.
BLOCK_VALUES, CHUNK_BYTES = 1000, 32 << 20
#: Orders of encodings, as a hit names the first.
ENCODINGS = ("plain", "reversed", "hex", "base64")


def _first(rows: DataFrame, by: Sequence[str], most: int | None, at: Sequence[str]) -> DataFrame:
    """Of each group the first ``most`` rows, with their place; sorted runs, none collected."""
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*at)))
    return rows if most is None else rows.where(F.col("_place") <= most)


def session_values(sources: DataFrame, min_length: int = MIN_LENGTH, most: int | None = MOST_VALUES) -> DataFrame:
    """``sources``: session_id, at, id, text (private results) -> session_id, value, since, source (the id that was read first), place from 1.

    Only the first ``most`` values of a session are kept; None keeps all.
    """
    values = sources.select("session_id", "at", "id", F.posexplode(secret_values(F.col("text"), min_length)).alias("pos", "value"))
    first = values.groupBy("session_id", "value").agg(F.min(F.struct("at", "id", "pos")).alias("f")).select("session_id", "value", F.col("f.at").alias("since"), F.col("f.id").alias("source"), F.col("f.pos").alias("pos"))
    return _first(first, ["session_id"], most, ["since", "source", "pos", "value"]).withColumnRenamed("_place", "place").drop("pos")


HITS = "id string, value string, source string, encoding string"


def tainted_calls(sources: DataFrame, sinks: DataFrame, min_length: int = MIN_LENGTH, most: int | None = MOST_VALUES) -> DataFrame:
    """``sources``: session_id, at, id, text; ``sinks``: session_id, at, id, text -> id, value, source, encoding, a row for each value a call carries out.

    A value counts if it was read before the call, plain, reversed, in hex or base64; texts are also looked at
    lower-cased and percent-decoded. ``encoding`` is the first of ``ENCODINGS`` that is there. A session's texts are
    cut into chunks of some ``CHUNK_BYTES`` and its values into blocks of ``BLOCK_VALUES``; each chunk meets each block,
    so no task holds more, whatever a session's share of all calls.
    """
    values = session_values(sources, min_length, most)
    needles = values.select("session_id", F.floor((F.col("place") - 1) / BLOCK_VALUES).cast("int").alias("block"), "value", "since", "source", F.explode(encodings(F.col("value"))).alias("needle"))
    same = lambda c: F.col("needle") == c
    needles = needles.withColumn("kind", F.when(same(F.col("value")), 0).when(same(F.reverse("value")), 1).when(same(F.lower(F.hex(F.col("value").cast("binary")))), 2).otherwise(3))
    size = sinks.groupBy("session_id").agg(F.ceil(F.sum(F.octet_length("text")) / CHUNK_BYTES).cast("int").alias("chunks"))
    plan = size.join(needles.groupBy("session_id").agg(F.max("block").alias("last")), "session_id")
    texts = sinks.join(plan, "session_id").select("session_id", "at", "id", "text", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.pmod(F.xxhash64("id"), F.greatest("chunks", F.lit(1))).cast("int").alias("chunk"))
    needles = needles.join(size, "session_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest("chunks", F.lit(1)) - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from urllib.parse import unquote_to_bytes

        import ahocorasick

        held: dict[str, list] = {}
        for r in right.select(["needle", "value", "since", "source", "kind"]).to_pylist():
            held.setdefault(r["needle"], []).append(r)
        out = []
        if held and left.num_rows:
            automaton = ahocorasick.Automaton()
            for needle, rows in held.items():
                automaton.add_word(needle, rows)
            automaton.make_automaton()
            for r in left.select(["id", "at", "text"]).to_pylist():
                best: dict[str, tuple] = {}
                text = r["text"] or ""
                looks = {text, text.lower()}
                if "%" in text:
                    looks.add(unquote_to_bytes(text).decode("utf-8", "replace"))
                for look in looks:
                    for _, rows in automaton.iter(look):
                        for v in rows:
                            if v["since"] < r["at"]:
                                best[v["value"]] = min(best.get(v["value"], (9, "")), (v["kind"], v["source"]))
                out += [(r["id"], value, source, ENCODINGS[kind]) for value, (kind, source) in best.items()]
        names = [f.split()[0] for f in HITS.split(", ")]
        return pa.table([pa.array(c, pa.string()) for c in (zip(*out) if out else [()] * 4)], names=names)

    by = ["session_id", "block", "chunk"]
    fresh = lambda x: x.select(*(F.col(c).alias(c) for c in x.columns))  # noqa: E731  both sides come from the same calls
    return fresh(texts).groupBy(*by).cogroup(fresh(needles).groupBy(*by)).applyInArrow(run, HITS)


# --- contracts ----------------------------------------------------------------------------------------


class FlowError(ValueError):
    """All that is wrong with a list of contracts."""


@dataclass
class Flow:
    """What was read from ``source`` tools (globs, or label:<name>) may not go to ``sink`` tools."""

    id: str
    source: list[str] = field(default_factory=list)
    sink: list[str] = field(default_factory=list)
    action: str = "deny"
    reason: str = ""


def load_flows(spec: list[dict]) -> list[Flow]:
    """Contracts from a list of mappings (id, from, to, action, reason); raises FlowError with every mistake."""
    errors, out, seen = [], [], set()
    for i, f in enumerate(spec):
        flow = Flow(f.get("id") or "", list(f.get("from") or []), list(f.get("to") or []), f.get("action") or "deny", f.get("reason") or "")
        flow.reason = flow.reason or REASON.format(id=flow.id, source=", ".join(flow.source), sink=", ".join(flow.sink))
        if not flow.id or flow.id in seen:
            errors.append(f"flow {i}: {'the id is used twice' if flow.id else 'it has no id'}")
        if flow.action not in ("deny", "ask", "warn"):
            errors.append(f"flow {i}: action {flow.action!r}")
        if not flow.source or not flow.sink:
            errors.append(f"flow {i}: both from and to are needed")
        seen.add(flow.id)
        out.append(flow)
    if errors:
        raise FlowError("\n".join(errors))
    return out


def _named(globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        p = glob_to_java(g)
        out = out | F.col("tool").rlike(p) | F.concat_ws(".", "upstream", "tool_name").rlike(p)
    return out


def _numbers(flows: Sequence[Flow], test) -> Column:
    """The places of the contracts that a call falls under."""
    return F.filter(F.array(*[F.when(F.coalesce(test(f), F.lit(False)), F.lit(i)) for i, f in enumerate(flows)]), lambda x: x.isNotNull())


def flow_places(flows: Sequence[Flow]) -> tuple[Column, Column]:
    """(contracts that a call's result is a source of, contracts that a call is a sink of), as places in ``flows``."""
    labelled = lambda f: F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.lit([g[6:] for g in f.source if g.startswith("label:")] or [""]))
    source = _numbers(flows, lambda f: _named([g for g in f.source if not g.startswith("label:")]) | labelled(f))
    return source, _numbers(flows, lambda f: _named(f.sink))


def flow_hits(calls: DataFrame, flows: Sequence[Flow], most: int | None = MOST_PRINTS) -> DataFrame:
    """``calls``: id, session_id, ts_ms, tool, upstream, tool_name, labels, args_json, result_text -> id, flow, action, reason.

    A row for each call whose arguments hold a passage of what an earlier call of its session read under a contract that
    forbids it to this tool; of several contracts the first decides. ``action`` is allow for warn. Of what a session
    read under a contract the first ``most`` fingerprints are kept; None keeps all.
    """
    source, sink = flow_places(flows)
    def rows(flow, text):
        c = calls.select("id", "session_id", F.col("ts_ms").alias("at"), flow.alias("flows"), text.alias("text")).where("size(flows) > 0 AND text <> ''")
        return printed(c, F.col("text"), ["id", "session_id", "at", "flows"]).select("id", "session_id", "at", F.explode("flows").alias("flow"), "pos", "print")

    key = ["session_id", "flow", "print"]
    read = rows(source, F.col("result_text")).groupBy(*key).agg(F.min(F.struct("at", "id", "pos")).alias("f"))
    read = read.select(*key, F.col("f.at").alias("since"), F.col("f.id").alias("reader"), F.col("f.pos").alias("pos"))
    if most is not None:
        read = _first(read, ["session_id", "flow"], most, ["since", "reader", "pos"])
    sent = rows(sink, F.col("args_json")).groupBy("id", "at", *key).agg(F.lit(1).alias("one"))
    hits = sent.join(read.select(*key, "since", "reader"), key).where((F.col("since") < F.col("at")) | ((F.col("since") == F.col("at")) & (F.col("reader") < F.col("id"))))
    first = hits.groupBy("id").agg(F.min("flow").alias("n"))
    said = F.lit([f.id for f in flows]), F.lit(["allow" if f.action == "warn" else f.action for f in flows]), F.lit([f.reason for f in flows])
    return first.select("id", *(F.get(x, F.col("n")).alias(name) for x, name in zip(said, ("flow", "action", "reason"))))


def with_flow(judged: DataFrame, hits: DataFrame) -> DataFrame:
    """Calls with ``verdict`` (of ``evaluate``): a contract's decision stands where it is stricter than the policy's; rule_id is then flow."""
    h = hits.select(F.col("id").alias("_id"), F.col("action").alias("_action"), F.col("reason").alias("_reason"))
    v = F.col("verdict")
    stricter = F.coalesce((strictest(F.array(v["action"], F.coalesce("_action", F.lit("allow")))) != v["action"]), F.lit(False))
    flow = F.struct(F.col("_action").alias("action"), F.col("_reason").alias("reason"), F.lit("flow").alias("rule_id"), F.lit(0).alias("quorum"))
    return judged.join(h, F.col("id") == F.col("_id"), "left").withColumn("verdict", F.when(stricter, flow).otherwise(v)).drop("_id", "_action", "_reason")
