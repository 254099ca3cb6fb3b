"""Live forms of the operators: the same transforms over streams of calls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import went_through
from ..sources.log import CALL_COLUMNS, upgraded


def call_stream(spark, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Calls as they are appended to a folder, columns an older writer left out at their defaults."""
    return upgraded(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), CALL_COLUMNS)


def event_time(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls with ``ts`` and its watermark; a call that arrives twice counts once."""
    return calls.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def tool_rates(calls: DataFrame, length: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """Calls, denials and tokens of each tool in sliding windows."""
    w = event_time(calls).groupBy(F.window("ts", length, slide), "tool")
    return w.agg(F.count("*").alias("calls"), F.count_if(F.col("decision") == "deny").alias("denied"), F.sum("tokens_est").alias("tokens")).select(F.unix_millis("window.start").alias("start_ms"), "tool", "calls", "denied", "tokens")


def session_ends(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions inferred from silence: start, end and calls."""
    w = event_time(calls).groupBy(F.session_window("ts", gap), "session_id")
    return w.agg(F.count("*").alias("calls")).select("session_id", F.unix_millis("session_window.start").alias("started_ms"), F.unix_millis("session_window.end").alias("ended_ms"), "calls")


#: Sessions are dealt to so many keys; each key sees the labels of all sessions.
LABEL_SHARDS = 16
EARNED = "pending array<struct<ts: bigint, id: string, session: string, labels: array<string>>>, tops array<struct<label: string, session: string, ts: bigint, other: string, other_ts: bigint>>"


def earned_elsewhere(calls: DataFrame, within: str = "30 minutes", late: str = "10 minutes", shards: int = LABEL_SHARDS) -> DataFrame:
    """For each call the labels that other sessions earned in the time before it: id, label, as ``ordered.shared_labels``.

    A stateful operator whose keys are shards of the sessions: a call goes to its session's shard, what a call earned to
    all of them (``shards`` times the few calls that earn anything). A shard keeps calls until the watermark has passed
    them and then takes them in order of time, calls of one moment before what they earn. Of each label the last two
    sessions to earn it are enough: one of them is not the caller's. So the state is as large as the traffic of ``late``.

    A call that arrives twice counts once, one that arrives behind the watermark is dropped. Calls that the watermark
    has not passed when a run ends wait in the state for the next run.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    span = int(pd.Timedelta(within).total_seconds() * 1000)
    rows = calls.select(F.timestamp_millis("ts_ms").alias("ts"), F.col("ts_ms").alias("at"), "id", F.col("session_id").alias("session"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    own = F.pmod(F.xxhash64("session"), F.lit(shards)).cast("int")
    to = F.when(F.size("labels") > 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    rows = rows.withWatermark("ts", late).withColumn("shard", F.explode(to)).withColumn("asks", own == F.col("shard"))

    def fold(key, batches, state):
        pending, tops = state.get if state.exists else ([], [])
        tops = {t[0]: list(t[1:]) for t in map(tuple, tops)}
        waiting = {r[1]: r for r in map(tuple, pending)}
        mark = state.getCurrentWatermarkMs()
        for b in batches:
            for r in b.itertuples():
                if r.at > mark:
                    # of calls that only bring labels the id is marked: they ask nothing here
                    waiting.setdefault(f"{'?' if r.asks else '!'}{r.id}", (int(r.at), f"{'?' if r.asks else '!'}{r.id}", r.session, list(r.labels)))
        ready = sorted(r for r in waiting.values() if r[0] <= mark)
        out, i = [], 0
        while i < len(ready):
            j = i
            while j < len(ready) and ready[j][0] == ready[i][0]:
                j += 1
            for at, name, session, _ in ready[i:j]:
                if name[0] == "?":
                    for label, (first, ts, other, other_ts) in tops.items():
                        seen = ts if first != session else other_ts
                        if seen is not None and seen >= at - span:
                            out.append((name[1:], label))
            for at, _, session, labels in ready[i:j]:
                for label in labels:
                    first, ts, other, other_ts = tops.get(label, (None, None, None, None))
                    tops[label] = [session, at, other, other_ts] if first == session or first is None else [session, at, first, ts]
            i = j
        pending = [r for r in waiting.values() if r[0] > mark]
        tops = [(label, *t) for label, t in tops.items() if t[1] >= mark - span]
        if pending or tops:
            state.update((pending, tops))
            state.setTimeoutTimestamp(max(mark + 1, min([r[0] for r in pending] or [max(t[2] for t in tops) + span])))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "label"])

    return rows.groupBy("shard").applyInPandasWithState(fold, "id string, label string", EARNED, "append", GroupStateTimeout.EventTimeTimeout)


def _epochs_before(spark, path: str, epoch: int, schema) -> DataFrame:
    """What earlier micro-batches wrote below ``path``; nothing of this one or later ones, which a replay overwrites."""
    try:
        return spark.read.schema(f"{schema}, epoch long").parquet(path).where(F.col("epoch") < epoch).drop("epoch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def chain_writer(path: str, chain: str = "session_id"):
    """What ``append_chains`` does with a micro-batch and its epoch: continue every chain from its stored head.

    Links go to ``path``/links, the new head of each chain that grew to ``path``/heads, a folder an epoch, so a micro-batch
    that is replayed writes the same rows over its own. Calls are linked in the order of the micro-batches they came in.
    """
    from ..operators import chain as chains

    def batch(df: DataFrame, epoch: int) -> None:
        heads = _epochs_before(df.sparkSession, f"{path}/heads", epoch, f"{chain} string, seq long, row_hash string")
        heads = heads.groupBy(chain).agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))
        chains.append(df, heads, chain).write.mode("overwrite").parquet(f"{path}/links/epoch={epoch}")
        links = df.sparkSession.read.parquet(f"{path}/links/epoch={epoch}")
        chains.head_links(links, chain).write.mode("overwrite").parquet(f"{path}/heads/epoch={epoch}")

    return batch


def append_chains(calls: DataFrame, path: str, chain: str = "session_id"):
    """A writer of chains that go on, below ``path``: see ``chain_writer``."""
    return calls.writeStream.foreachBatch(chain_writer(path, chain))


def spend_writer(path: str, amount):
    """What ``spend_ledger`` does with a micro-batch and its epoch: the day's spending with each forwarded call, as ``ordered.daily_ledger``.

    Within a micro-batch calls are summed in order of time and id; what earlier ones spent on a day comes from its totals,
    so every day starts at nothing and a late call joins its own day, after the calls that were there before it.
    Rows go to ``path``/spent, a micro-batch's totals by day to ``path``/days, a folder an epoch: a replay writes the same.
    """
    from ..operators import ordered

    day = F.floor(F.col("ts_ms") / 86_400_000).cast("long")

    def batch(df: DataFrame, epoch: int) -> None:
        before = _epochs_before(df.sparkSession, f"{path}/days", epoch, "day long, amount double").groupBy("day").agg(F.sum("amount").alias("before"))
        spent = ordered.daily_ledger(df, amount).join(df.select("id", day.alias("day")), "id").join(F.broadcast(before), "day", "left")  # a row a day
        spent.select("id", F.round(F.col("spent") + F.coalesce("before", F.lit(0.0)), 6).alias("spent")).write.mode("overwrite").parquet(f"{path}/spent/epoch={epoch}")
        went = df.where(went_through()).groupBy(day.alias("day")).agg(F.sum(amount).alias("amount"))
        went.write.mode("overwrite").parquet(f"{path}/days/epoch={epoch}")

    return batch


def spend_ledger(calls: DataFrame, path: str, amount):
    """A writer of the day's spending over micro-batches, below ``path``: see ``spend_writer``."""
    return calls.writeStream.foreachBatch(spend_writer(path, amount))


STATE = "calls long, tokens long, streak long, signature string, recent array<long>, labels array<string>"
COUNTED = "id string, session_id string, session_calls long, tokens long, repeats long, last_minute long, labels array<string>"


def session_counters(calls: DataFrame, ttl_ms: int | None = 24 * 3_600_000) -> DataFrame:
    """For each call the session's counters as they stood before it: what budgets, the loop guard and label rules look at.

    A stateful operator keyed by session. Within a micro-batch calls are folded in
    order of time and id; a session silent for ``ttl_ms`` of processing time is forgotten.
    A run that is to end by itself (``availableNow``) needs ``ttl_ms=None``: timeouts ask for ever more batches.
    """

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, tokens, streak, signature, recent, labels = state.get if state.exists else (0, 0, 0, "", [], [])
        recent, labels, out = list(recent), set(labels), []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", "id"]).itertuples():
            sig = f"{r.tool}\x00{r.args_hash}"
            repeats = streak if sig == signature else 0
            streak, signature = repeats + 1, sig
            recent = [t for t in recent if t > r.ts_ms - 60_000]
            out.append((r.id, key[0], n, tokens, repeats, len(recent), sorted(labels)))
            if r.decision == "allow" or r.shadow:
                n, tokens = n + 1, tokens + int(r.tokens_est)
                recent.append(int(r.ts_ms))
                labels.update(r.labels)
        state.update((n, tokens, streak, signature, recent, sorted(labels)))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in COUNTED.split(", ")])

    c = calls.select("id", "session_id", "ts_ms", "tool", "args_hash", "decision", "shadow", "tokens_est", "labels")
    return c.groupBy("session_id").applyInPandasWithState(fold, COUNTED, STATE, "append", "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout")


READ = "prints array<struct<flow: int, held: array<bigint>>>, values array<struct<value: string, source: string>>"
STOPS = "id string, rule string, what string, source string"


def leaving(calls: DataFrame, flows=(), private: tuple[str, ...] = (), most_prints: int | None = None, most_values: int | None = None, ttl_ms: int | None = 24 * 3_600_000) -> DataFrame:
    """Calls that carry out what their session read before: id, rule (flow or taint), what (the contract, or the encoding), source (of a value).

    A stateful operator keyed by session, beside ``flows.flow_hits`` and ``flows.tainted_calls``: its state is the
    fingerprints read under each contract and the secret values read in results that earned a ``private`` label, the
    first of each up to the bounds (by default those of the batch operators). Calls of a micro-batch are taken in order of
    time and id, each judged by what stood before it. A session silent for ``ttl_ms`` of processing time is forgotten;
    a run that is to end by itself needs ``ttl_ms=None``.
    """
    from ..detect import flows as contracts
    from ..detect.secrets import passage_prints, secret_values

    most_prints = contracts.MOST_PRINTS if most_prints is None else most_prints
    most_values = contracts.MOST_VALUES if most_values is None else most_values
    source, sink = contracts.flow_places(flows)
    none = F.array().cast("array<string>")
    is_private = F.arrays_overlap(F.coalesce("labels", none), F.lit(list(private) or [""]))
    text = lambda test, c: F.when(test, F.coalesce(F.col(c), F.lit(""))).otherwise("")
    looked = calls.select(
        "id", "session_id", "ts_ms", source.alias("of"), sink.alias("into"), F.coalesce("args_json", F.lit("")).alias("args"),
        passage_prints(text(F.size(source) > 0, "result_text")).alias("read"), passage_prints(text(F.size(sink) > 0, "args_json")).alias("sent"), F.when(is_private, secret_values(text(is_private, "result_text"))).otherwise(none).alias("secrets"),
    )
    names = [x.split()[0] for x in STOPS.split(", ")]

    def kinds(value: str) -> dict[str, str]:
        return {value: "plain", value[::-1]: "reversed", value.encode().hex(): "hex"}

    def fold(key, batches, state):
        from urllib.parse import unquote_to_bytes

        from ..detect.secrets import base64_fragments

        if state.hasTimedOut:
            state.remove()
            return
        prints, values = state.get if state.exists else ([], [])
        held = {p[0]: dict.fromkeys(p[1]) for p in map(tuple, prints)}
        kept = {v[0]: v[1] for v in map(tuple, values)}
        forms = {v: kinds(v) | dict.fromkeys([f for url in (False, True) for f in base64_fragments(v, url)], "base64") for v in kept}
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", "id"]).itertuples():
            sent = [int(p) for p in r.sent]
            for i in map(int, r.into):
                if not held.get(i, {}).keys().isdisjoint(sent):
                    out.append((r.id, "flow", flows[i].id, None))
                    break
            looks = {r.args, r.args.lower()} | ({unquote_to_bytes(r.args).decode("utf-8", "replace")} if "%" in r.args else set())
            for value, origin in kept.items():
                how = [name for form, name in forms[value].items() if any(form in x for x in looks)]
                if how:
                    out.append((r.id, "taint", min(how, key=contracts.ENCODINGS.index), origin))
            for i in map(int, r.of):
                own = held.setdefault(i, {})
                for p in map(int, r.read):
                    if len(own) >= most_prints:
                        break
                    own[p] = None
            for v in r.secrets:
                if v not in kept and len(kept) < most_values:
                    kept[v] = r.id
                    forms[v] = kinds(v) | dict.fromkeys([f for url in (False, True) for f in base64_fragments(v, url)], "base64")
        state.update(([(i, list(p)) for i, p in held.items()], list(kept.items())))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=names)

    return looked.groupBy("session_id").applyInPandasWithState(fold, STOPS, READ, "append", "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout")


def tail(calls: DataFrame, sink, last_seq: int = -1):
    """Follow the log: each micro-batch's new calls in chain order go to ``sink(rows)``."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.where(F.col("seq") > last_seq).orderBy("seq")
        sink(rows)

    return calls.writeStream.foreachBatch(batch)


def notifications(calls: DataFrame, events: tuple[str, ...] = ("denied", "honeypot", "canary", "quarantine", "error")) -> DataFrame:
    """Event rows of the subscribed kinds, as JSON."""
    kind = F.when(F.col("rule_id").isin("honeypot", "canary", "quarantine"), F.col("rule_id")).when((F.col("decision") == "deny") & ~F.col("shadow"), "denied").when(F.col("is_error"), "error").when(went_through(), "allowed")
    e = calls.withColumn("event", kind).where(F.col("event").isin(*events))
    return e.select(F.to_json(F.struct("event", "id", "session_id", "tool", "ts_ms", "rule_id")).alias("value"))


def shaped(text: str, shape: str) -> str:
    """A notification for a chat service: its text under the key that service reads."""
    key = {"slack": "text", "discord": "content"}.get(shape)
    return json.dumps({key: text}) if key else text
