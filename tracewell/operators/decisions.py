"""Decisions that are folded from several rows: quorums of answers, requests of a server to its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import re2_to_java

#: A quorum is at most so many people.
MOST_PEOPLE = 9
# Fixed value: what marks a field that asks for a secret.
CREDENTIAL_NAME = r"(?i)(pass(word|phrase)?|secret|token|api[_-]?key|credential|private[_-]?key|otp|2fa|mfa|pin\b|cvv|card[_-]?number|seed|mnemonic)"
STRICTNESS = {"allow": 0, "ask": 1, "deny": 2}


def quorum(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``requests``: request, quorum; ``answers``: request, seq, channel, who, allow, for_session -> request, action, approvals, for_session.

    A denial before the quorum is reached denies. Approvals count once a person; who is unknown counts once a channel. Answers
    without a channel are channels that gave up. The approval is for the session only if everyone of the quorum said so.
    """
    a = answers.where("channel <> ''").withColumn("person", F.when(F.coalesce("who", F.lit("")) == "", F.struct("channel", F.lit("").alias("who"))).otherwise(F.struct(F.lit("").alias("channel"), "who")))
    denied = a.where(~F.coalesce("allow", F.lit(False))).groupBy("request").agg(F.min("seq").alias("denied_at"))
    first = a.where("allow").groupBy("request", "person").agg(F.min_by(F.coalesce("for_session", F.lit(False)), "seq").alias("for_session"), F.min("seq").alias("seq"))
    # no quorum is larger: of each request the first few approvals are ranked and the rest never sorted
    place = F.row_number().over(Window.partitionBy("request").orderBy("seq", "person"))
    first = first.withColumn("place", place).where(F.col("place") <= MOST_PEOPLE)
    r = requests.join(denied, "request", "left").join(first, "request", "left")
    counts = (F.col("place") <= F.col("quorum")) & (F.col("denied_at").isNull() | (F.col("seq") < F.col("denied_at")))
    r = r.groupBy("request", "quorum", "denied_at").agg(F.count_if(counts).alias("approvals"), F.bool_and(F.when(counts, F.col("for_session"))).alias("all_session"))
    reached = F.col("approvals") >= F.col("quorum")
    return r.select("request", F.when(reached, "allow").otherwise("deny").alias("action"), "approvals", (reached & F.coalesce("all_session", F.lit(False))).alias("for_session"))


def credential_field(schema: Column) -> Column:
    """The first field, by name, of a JSON schema's properties that asks for something like a secret; else null."""
    fields = F.map_entries(F.from_json(F.get_json_object(schema, "$.properties"), "map<string, struct<title: string, description: string, format: string>>"))
    said = lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"]["title"], F.lit("")), F.coalesce(e["value"]["description"], F.lit("")))
    asks = lambda e: F.coalesce(e["value"]["format"] == "password", F.lit(False)) | said(e).rlike(re2_to_java(CREDENTIAL_NAME))
    return F.array_min(F.transform(F.filter(fields, asks), lambda e: e["key"]))


def input_requests(requests: DataFrame, sampling: str = "ask", elicitation: str = "ask", shadow: bool = False) -> DataFrame:
    """``requests``: call_id, seq, kind (sampling or elicitation), schema -> call_id, action, kind, credential of the first strictest request.

    ``would`` is what that request would get; in shadow mode ``action`` is allow whatever it is.
    """
    would = F.when(F.col("kind") == "elicitation", elicitation).otherwise(sampling)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STRICTNESS.items() for x in kv]), would)
    chosen = F.max_by(F.struct(would.alias("would"), "kind", credential_field(F.col("schema")).alias("credential")), F.struct(rank.alias("rank"), -F.col("seq")))
    return requests.groupBy("call_id").agg(chosen.alias("r")).select("call_id", F.lit("allow").alias("action") if shadow else F.col("r.would").alias("action"), "r.would", "r.kind", "r.credential")
