"""Awkward rows of the operators: very long values, ids that are null or repeated, clashing names, empty tables."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import ann, langid, lm_scoring, media, mixing, packing, registry, repair, token_counts, url_filters, warc

DOCS = "doc_id long, text string, source string, size long, block int, n_tokens int"
LONG = "wörd another " * 60_000 + "x" * 300_000


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "ab"[i % 2], 9, 9, 9) for i, t in enumerate(texts)], DOCS)


def test_repeated_and_missing_vector_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i // 2, rng.standard_normal(8).tolist()) for i in range(40)] + [(None, rng.standard_normal(8).tolist()), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, query_id int")
    got = ann.nearest(df, F.col("vec_id") == 0, share=9.0).collect()
    vectors = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    # an id that stands for two vectors asks with each, and is a candidate with each
    want = {round(cos(q, v), 9) for k, q in vectors if k == 0 for i, v in vectors if i != 0}
    assert got and {round(r["score"], 9) for r in got} <= want and all(r["vec_id"] not in (0, None) and r["query_id"] == 0 for r in got)
    assert round(max(r["score"] for r in got), 9) == max(want)


def test_very_long_addresses_and_names_that_clash(spark):
    path = "a" * 200_000
    df = spark.createDataFrame([(1, f"http://EXAMPLE.com/en/{path}", 1, "x", "y"), (2, "http://" + "h" * 100_000 + ".net/fr/", 2, "x", "y"), (3, "://", 3, "x", "y")], "page_id long, url string, outcome_key long, host string, rule string")
    bad = spark.createDataFrame([(1, False)], "outcome_key long, bad boolean")
    got = {r["page_id"]: (len(r["host"]), len(r["path"]), r["rule"], r["verdict"]) for r in url_filters.judge(df, bad).collect()}
    assert got == {1: (11, 200_004, "example.com/en/", "block"), 2: (100_004, 4, "net/fr/", "block"), 3: (0, 0, None, "allow")}


def test_very_long_texts(spark):
    df = docs(spark, LONG, "one two", "", None, LONG)
    scored = {r["doc_id"]: r for r in lm_scoring.score(df, F.col("doc_id") == 1).collect()}
    n = len(LONG.split()) + 1
    assert [scored[i]["n_tokens"] for i in range(5)] == [n, 3, 1, 1, n] and scored[0]["score"] == scored[4]["score"] and all(np.isfinite(r["score"]) for r in scored.values())
    mixed = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert mixed == {0: n - 1, 1: 2, 2: 0, 3: 0, 4: n - 1}
    path = registry.vocabulary_file("word_bpe_49k.json")
    ids = np.frombuffer(next(packing.text_tokenizer(path)(pa.array([LONG]))), "<u4")
    packed = packing.pack(df, path).where("doc_id = 0").agg(F.sum("length"), F.max("length")).first()
    assert tuple(packed) == (len(ids) + 1, 4096)
    whole = {r["doc_id"]: r["n_tokens"] for r in repair.round_trip(df, path).collect()}
    assert whole[0] == whole[4] == len(ids) + 1 and whole[3] == 1


def test_token_counts_of_long_and_no_texts(spark, monkeypatch):
    path = registry.vocabulary_file("piece_bpe_32k.model")
    texts = ["word " * 3000, "x" * 20_000, " ".join("abc"[i % 3] * (i % 40 + 1) for i in range(500)), None, ""]
    want = [tuple(r) for r in token_counts.count_tokens(docs(spark, *texts).coalesce(1), path).orderBy("doc_id").collect()]
    assert want[0][1] == 3000 and want[1][1] == 1 and want[3][1:] == want[4][1:] == (0, 0)
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), path).count() == 0
    one = token_counts.count_tokens(docs(spark, *texts[:1]), path).first()
    assert one["n_tokens"] == want[0][2]


def test_archives_of_long_pages(spark):
    html = "é<p>" * 100_000
    df = spark.createDataFrame([(1, "u", html, "x"), (2, "u", html, "x"), (3, "u", "", "x"), (4, "u", None, "x")], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    data = html.encode()
    empty = (0, hashlib.sha1(b"").hexdigest(), "response", None)
    assert got == {1: (len(data), hashlib.sha1(data).hexdigest(), "revisit", 2), 2: (len(data), hashlib.sha1(data).hexdigest(), "response", None), 3: empty, 4: empty}


def test_markup_language_and_its_text(spark):
    rows = ["<!doctype html><HTML class='x' LANG = 'pt-BR'>", "<html lang=fr>", '<html data-x="1" lang="DE">', "<p lang='en'>", "<html>", "", None, "<html xml:lang='it'>"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(langid.html_lang(F.col("h"))).collect()]
    assert got[:7] == ["pt", "fr", "de", None, None, None, None]


def test_long_image(spark):
    r = media.media_columns(docs(spark, LONG, None)).orderBy("doc_id").collect()
    assert r[0]["n_bytes"] == len(LONG.encode()) and r[1]["n_bytes"] == 0 and r[1]["payload_bytes"] == 576 and len(r[0]["feature"]) == 16
