"""What a task or the driver holds does not follow the table."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_flows import CALLS, contract
from tracewell.detect import flows, secrets
from tracewell.functions.batches import slices
from tracewell.operators import ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_taken_by_bytes():
    texts = ["a" * 10, None, "b" * 90, "c" * 300, "", "d" * 50]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], names=["t", "i"])
    got = [s.column("t").to_pylist() for s in slices(b, "t", most=100)]
    assert got == [texts[:3], [texts[3], ""], [texts[5]]] or [x for s in got for x in s] == texts and all(len(s) == 1 or sum(len(x or "") for x in s) <= 100 for s in got)
    assert len(got) > 1 and not list(slices(b.slice(0, 0), "t"))


def test_no_frame_is_open_at_its_far_end(spark):
    calls = spark.createDataFrame([("a", "s", 1, ["x"])], "id string, session_id string, ts_ms long, labels array<string>")
    assert "unboundedfollowing" not in plan(ordered.shared_labels(calls)).lower()


def test_fingerprints_do_not_carry_their_texts(spark):
    texts = spark.createDataFrame([], "id long, text string")
    for df in (secrets.passage_flow(texts, texts), flows.flow_hits(spark.createDataFrame([], CALLS), contract())):
        made = [line.split("MapInArrow run(")[1].partition("[")[2] for line in plan(df).splitlines() if "MapInArrow run(" in line]
        assert len(made) == 2 and all("print#" in x and "text#" not in x for x in made)


@pytest.mark.parametrize("n", [0, 15, 16, 23, 24, 25, 40, 47, 48, 49, 300])
def test_long_texts_are_taken_by_the_piece(n):
    text = "".join(np.random.default_rng(n).choice(list("abcé \U0001f600"), n))
    for most in (1, 7, 24, 25):
        assert secrets.text_prints(text, most=most).tolist() == secrets.text_prints(text, most=10**9).tolist()
