"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, lm_scoring, media, mixing, oracles, packing, prefix_trie, repair, simhash, token_counts, url_filters, vector_codes, warc
from .common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its document's label (the number in its address): bad if toxic or of low quality."""
    key = F.regexp_extract("url", r"/(\d{1,18})(?:[^0-9]|$)", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", key.alias("outcome_key"))
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return url_filters.judge(pages, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("outcome_key"), bad.alias("bad")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their lang column is the declaration, their source the host; they have no address."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return langid.identify(d).withColumn("posterior", F.round("posterior", 6))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup language, address suffix and host beside the text of the html."""
    host, _ = url_filters.split_url(F.col("url"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"), langid.html_lang(F.col("html")).alias("declared"), host.alias("host"))
    return langid.identify(p.withColumn("suffix", F.regexp_extract("host", r"([^.:]+)(:\d+)?$", 1))).withColumnRenamed("doc_id", "page_id").withColumn("posterior", F.round("posterior", 6))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def vocabulary_file(name: str) -> str:
    """Place of a public vocabulary's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.dedupe(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = media.media_columns(table(spark, sf_dir, "documents"))
    return f.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.nodes(rebuilt).drop("shard", "slot", "base", "check", "turn_key")


def queries() -> dict:
    ops = (op1_ann, op2_url_filters, op3_langid, langid_pages, op4_lm_scoring, op5_mixing, op6_packing, op7_token_counts, op8_warc, op9_simhash, op10_media, op11_vector_codes, op12_token_ids, op13_prefix_trie)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": oracles.OP2, "op8_warc": oracles.OP8, "op11_vector_codes": oracles.OP11, "op13_prefix_trie": oracles.OP13}
