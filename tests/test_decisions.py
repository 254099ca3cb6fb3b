import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import documents
from tracewell.operators import chain, decisions


def folded(quorum, answers):
    """The answers in the order they came, one after the other."""
    seen, together = set(), True
    for channel, who, allow, session in answers:
        if not channel:
            continue
        if not allow:
            break
        if (who or ("", channel)) not in seen:
            seen.add(who or ("", channel))
            together = together and bool(session)
            if len(seen) >= quorum:
                return "allow", len(seen), together
    return "deny", len(seen), False


def test_quorum(spark):
    rng = random.Random(1)
    cases = {i: (rng.randint(1, 4), [(rng.choice(["", "a", "b"]), rng.choice([None, "", "x", "y", "z"]), rng.random() > 0.1, rng.choice([True, True, None, False])) for _ in range(rng.randint(0, 12))]) for i in range(200)}
    requests = spark.createDataFrame([(i, q) for i, (q, _) in cases.items()], "request long, quorum int")
    answers = spark.createDataFrame([(i, n, *a) for i, (_, rows) in cases.items() for n, a in enumerate(rows)], "request long, seq long, channel string, who string, allow boolean, for_session boolean")
    got = {r["request"]: (r["action"], r["approvals"], r["for_session"]) for r in decisions.quorum(requests, answers).collect()}
    assert got == {i: folded(q, rows) for i, (q, rows) in cases.items()}


def test_input_requests(spark):
    rows = [("a", 1, "sampling", None), ("a", 2, "elicitation", '{"properties":{"b":{"description":"your passphrase"},"a":{}}}'), ("b", 1, "sampling", "{"), ("c", 1, "elicitation", '{"properties":{"x":null}}')]
    df = spark.createDataFrame(rows, "call_id string, seq long, kind string, schema string")
    got = {r["call_id"]: (r["action"], r["would"], r["kind"], r["credential"]) for r in decisions.input_requests(df, "allow", "ask").collect()}
    assert got == {"a": ("ask", "ask", "elicitation", "b"), "b": ("allow", "allow", "sampling", None), "c": ("ask", "ask", "elicitation", None)}
    assert {r["action"] for r in decisions.input_requests(df, "allow", "deny", shadow=True).collect()} == {"allow"}
    assert decisions.input_requests(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 33, 64])
def test_log_head_in_blocks(spark, n):
    leaves = [hashlib.sha256(b"\x00%d" % i).digest() for i in range(70)]

    def head(x):  # as RFC 6962 defines it
        if len(x) <= 1:
            return x[0] if x else hashlib.sha256(b"").digest()
        k = 1 << ((len(x) - 1).bit_length() - 1)
        return hashlib.sha256(b"\x01" + head(x[:k]) + head(x[k:])).digest()

    df = spark.createDataFrame([(i, h.hex()) for i, h in enumerate(leaves)], "place long, leaf string")
    assert [tuple(r) for r in chain.log_head(df, n, 4).collect()] == [(n, head(leaves[:n]).hex())]


def test_log_head_of_a_cut_log(spark):
    df = spark.createDataFrame([(i, hashlib.sha256(b"%d" % i).hexdigest()) for i in range(5)], "place long, leaf string")
    assert chain.log_head(df, 6, 2).count() == 0


def test_definition_hash(spark):
    texts = ['{"name":"a","title":null,"inputSchema":{"b":1.0,"a":2}}', ' {"inputSchema":{"a":2,"b":1.0},"name":"a","annotations":{}}', '{"name":"a","inputSchema":{"a":2,"b":1}}', "[1]", "{", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(documents.definition_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == "sha256:" + hashlib.sha256(b'{"inputSchema":{"a":2,"b":1.0},"name":"a"}').hexdigest()
    assert got[2] not in (None, got[0]) and got[3:] == [None, None, None]
