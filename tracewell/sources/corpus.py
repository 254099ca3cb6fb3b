"""Labelled corpora of definitions and results, and how well the scanners do on them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detect import scan

CORPUS = "id string, attack boolean, technique string, others array<struct<upstream: string, name: string>>, def string, text string"


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of labelled definitions (def) or results (text) -> the columns of ``CORPUS``; files of a folder or a glob together.

    An id that is used twice, or an entry without one, is an error.
    """
    import yaml

    rows: list[tuple] = []
    for r in spark.read.text(path, wholetext=True).toLocalIterator():
        for e in yaml.safe_load(r["value"]) or []:
            others = [(o["upstream"], o["name"]) for o in e.get("others") or []]
            rows.append((e.get("id"), bool(e.get("attack")), e.get("technique"), others, json.dumps(e["def"]) if "def" in e else None, e.get("text")))
    ids = [r[0] for r in rows]
    wrong = sorted({str(i) for i in ids if i is None or ids.count(i) > 1})
    if wrong:
        raise ValueError(f"ids are missing or used twice: {', '.join(wrong)}")
    return spark.createDataFrame(rows, CORPUS)


def judged(corpus: DataFrame) -> DataFrame:
    """id, attack, technique, caught of every entry, as the scanners see it. Other servers' tools are those of the entry."""
    member = lambda k: F.get_json_object("def", f"$.{k}").alias(k)
    members = [member(k) for k in ("name", "title", "description", "uri", "inputSchema", "outputSchema", "annotations", "arguments")]
    found = scan.result_findings(corpus.where("text IS NOT NULL").select("id", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))).alias("result_json"))).select("id")
    for r in corpus.where("def IS NOT NULL").select("others").distinct().collect():  # a few lists
        same = corpus.where("def IS NOT NULL").where(F.to_json("others") == json.dumps([o.asDict() for o in r["others"]], separators=(",", ":"), ensure_ascii=False))
        found = found.union(scan.definition_findings(same.select("id", *members), [(o["upstream"], o["name"]) for o in r["others"]]).select("id"))
    caught = found.distinct().withColumn("caught", F.lit(True))
    return corpus.join(caught, "id", "left").select("id", "attack", "technique", F.coalesce("caught", F.lit(False)).alias("caught"))
