"""Language ID keeps clean documents whatever their ids, copies and number of languages."""

import numpy as np
import pytest

from tracewell.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SAID = {"en": "the house and the river are old and they were here", "fr": "la maison et la riviere sont vieilles et elles furent"}


def bilingual(n):
    rng = np.random.default_rng(1)
    said = {k: v.split() for k, v in SAID.items()}
    return [(i, f"{' '.join(rng.permutation(said[lang]))} n{i}", lang) for i in range(n) for lang in [("en", "fr")[i % 2]]]


@pytest.mark.parametrize("ids", ["own", "none", "one"])
def test_sample_is_by_text(spark, ids):
    n = 6000  # well beyond the sample
    rows = [({"own": i, "none": None, "one": 7}[ids], text, lang, "a", 0) for i, text, lang in bilingual(n)]
    assert langid.keep_identified(spark.createDataFrame(rows, DOCS), "lang", "source", train_rows=1200).count() == n


def test_copies_do_not_crowd_out_a_language(spark):
    rows = [(i, text, lang, "a", 0) for i, text, lang in bilingual(3000)] + [(None, "la maison la maison la maison", "fr", "a", 0)] * 20_000
    kept = langid.keep_identified(spark.createDataFrame(rows, DOCS), "lang", "source", train_rows=1000)
    assert kept.count() == len(rows)


def test_every_declared_language_is_a_class(spark):
    """More languages than fit the model at its finest: each word of a language is its own."""
    rng = np.random.default_rng(2)
    tags = [a + b for a in "abcdefghijkl" for b in "mnopqrstuvwx"]
    rows = []
    for k, tag in enumerate(tags):
        letters = list(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False))
        vocab = ["".join(rng.choice(letters, 5)) for _ in range(30)]
        rows += [(k * 100 + i, " ".join(rng.choice(vocab, 40)), tag, "s", 0) for i in range(12)]
    kept = langid.keep_identified(spark.createDataFrame(rows, DOCS), "lang", "source")
    assert len(tags) == 144 and kept.count() == len(rows)


def test_very_long_text_and_clashing_columns(spark):
    rows = [(i, text, lang, "a", 0) for i, text, lang in bilingual(400)] + [(999, SAID["fr"] * 20_000, "fr", "a", 0), (998, "", "fr", "a", 0), (997, None, "fr", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "h")
    kept = langid.keep_identified(df, "lang", "source")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(400)) | {999}
