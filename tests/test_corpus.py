"""The scanners on the labelled corpus: one that gets worse fails here."""

from pathlib import Path

import pytest

from tracewell.operators import audit
from tracewell.sources import corpus

HERE = Path(__file__).parent / "corpus"
#: Least share of attacks caught and largest of false alarms.
FLOORS = {"definitions": (0.90, 0.05), "results": (0.90, 0.10)}


@pytest.mark.parametrize("name", sorted(FLOORS))
def test_floors(spark, name):
    seen = corpus.judged(corpus.labelled(spark, str(HERE / f"{name}.yaml"))).cache()
    rates = audit.classify(seen).first()
    wrong = sorted((r["id"], r["outcome"]) for r in audit.missed(seen).collect())
    assert rates["attacks"] >= (20 if name == "definitions" else 10) and rates["benign"] >= (25 if name == "definitions" else 10)
    assert rates["detection"] >= FLOORS[name][0] and rates["false_alarm_rate"] <= FLOORS[name][1], wrong
    assert rates["detection"] < 1, "the corpus holds cases that are known to be missed"


def test_ids_are_unique(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {id: x, attack: true, text: a}\n")
    (tmp_path / "b.yaml").write_text("- {id: x, attack: false, def: {name: n}}\n- {attack: true, text: b}\n")
    with pytest.raises(ValueError, match="None, x"):
        corpus.labelled(spark, str(tmp_path / "*.yaml"))
    (tmp_path / "c.yaml").write_text("")
    assert corpus.labelled(spark, str(tmp_path / "c.yaml")).count() == 0 and corpus.labelled(spark, str(tmp_path / "a.yaml")).first()["technique"] is None
