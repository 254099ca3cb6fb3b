"""The pipeline on the smallest tables: each stage's decisions, checked from its input."""

import collections

import numpy as np

import corpus_pipeline
from tests.llm.test_near_duplicates import kept_by_all_pairs
from tracewell.llm.common import words


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    seen = [ids]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 3:
            assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[1] <= ids and len(seen[1]) >= 0.97 * len(ids)
    after = spark.read.parquet(str(tmp_path / "near_duplicates")).collect()
    assert len({r["doc_id"] for r in after}) == len(after)
    texts = collections.Counter(b" ".join(words(r["text"])) for r in after)
    assert max(texts.values()) == 1
    packed = docs.collect()
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and sum(fill.values()) / (4096 * len(fill)) > 0.9
    assert sorted(map(str, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_awkward_documents(spark, tmp_path):
    """run() on null and repeated ids, empty texts, clashing names and copies: every stage against a plain version."""
    rng = np.random.default_rng(1)
    said = {"en": "the house and the river are old and", "fr": "la maison et la riviere sont vieilles et"}
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        body = " ".join(rng.permutation(said[lang].split() * 3)) + f" n{i} m{i} k{i}"
        rows.append((None if i % 10 == 0 else i // 2, body, lang, (None, "a", "b")[i % 3], i, i, i, i))
    rows += [(500 + k, rows[3][1], "fr", "a", 0, 0, 0, 0) for k in range(40)] + [(None, None, "en", "a", 0, 0, 0, 0), (7, "", "en", "b", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _words int, _nth int, said int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [tuple(r) for r in corpus_pipeline.language(spark, df, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if r[1])
    once = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, df.schema), str(tmp_path)).collect()]
    assert len(once) == len(kept_by_all_pairs([r[1] for r in kept])) and set(once) <= set(kept)
    assert sum(r[1] == rows[3][1] for r in once) <= 1
    mixed = [tuple(r) for r in corpus_pipeline.mixture(spark, spark.createDataFrame(once, df.schema), str(tmp_path)).collect()]
    assert set(mixed) <= set(once) and max(collections.Counter(mixed).values()) <= 3
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r[0] for r in mixed)
    empty = tmp_path / "empty"
    spark.createDataFrame([], df.schema).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
