"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are added as log-probabilities of each language:

* the text: byte trigrams of the lower-cased text under naive Bayes, with an
  ``other`` class that spreads its mass evenly (junk and unknown languages);
* the declared markup language (an ``html lang`` attribute or a metadata
  column): a confusion matrix with reliability ``DECLARED_TRUST``;
* the address suffix: languages whose countries use it, with ``SUFFIX_TRUST``;
* the host: the prior of languages on it, counted over all rows by grouped
  aggregation and smoothed host -> registered domain -> all rows with
  ``HOST_STRENGTH`` pseudo-rows a level; a row's own declaration is left out of
  its counts, so it is not used twice.

Declarations count by their primary subtag, lower-cased (``en-US`` and ``EN`` are
``en``); what has none is no declaration. The classes are all languages that are
declared.  The text model is fitted on a bounded sample of the distinct texts
declared, as many of each language (``TRAIN_ROWS`` in all or 500 a language, by
hash of the text, whatever the ids and however many copies), counted in tasks and
summed by Spark; all other counts cover all rows.  The model holds at most
``MODEL_FLOATS`` numbers: from 128 languages on trigrams share fewer
buckets.  Scoring is one pass over the texts; only the host table is joined to
them, by host, after texts have become scores.

A row is kept if its best language is not ``other`` and has a posterior of at
least ``KEEP``.  Edge cases: a null or letterless text has no text evidence and
is rejected as ``und``; a null declaration, suffix or host is no evidence; with
no declared rows at all nothing can be learned and every row is ``und`` and
rejected; repeated rows are judged one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, materialize, plain_names

TRAIN_ROWS, EACH_ROWS, BUCKETS, ALPHA = 20000, 500, 1 << 16, 0.5
#: Numbers that the broadcast text model holds at most.
MODEL_FLOATS = 1 << 23
#: Bytes of host priors that are broadcast at most (two doubles a host and language); more of them are joined by shuffle.
BROADCAST_BYTES = 16 << 20
DECLARED_TRUST, SUFFIX_TRUST, HOST_STRENGTH, KEEP = 0.9, 0.6, 20.0, 0.6
#: A text's trigrams are not independent: their log-likelihood is tempered, and never counts as more than this many.
TEMPER, MOST_TRIGRAMS = 0.5, 200.0
OTHER, OTHER_SPREAD = "other", 4
#: Languages that an address suffix speaks for. Fixed values, by country.
SUFFIX_LANGUAGES = {"at": "de", "ch": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "be": "fr", "uk": "en", "us": "en", "ie": "en", "au": "en"}
#: Bytes that part words become one blank.
_BLANKS = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else LOWER_BYTES[b] for b in range(256))


def trigrams(text: str, shift: int = 16) -> np.ndarray:
    """Buckets (2^(32 - shift) of them) of the byte trigrams that hold a letter; runs of non-letters are one blank."""
    data = re.sub(rb" +", b" ", b" " + text.encode("utf-8", "surrogatepass").translate(_BLANKS) + b" ")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(shift)).astype(np.int64)


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower-cased; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1)), F.lit(""))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """``docs``: text, declared -> {languages, weights float32[buckets, languages + 1]}; the sample is bounded by ``train_rows``."""
    declared = docs.withColumn("declared", primary(F.col("declared"))).where("declared IS NOT NULL AND text IS NOT NULL").select("declared", "text", F.xxhash64(F.lit(7), "text").alias("h"))
    texts = {r["declared"]: r["n"] for r in declared.groupBy("declared").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # a row a subtag of two or three letters
    each = max(EACH_ROWS, train_rows // max(1, len(texts)))
    shift = max(16, 32 - (MODEL_FLOATS // (len(texts) + 1)).bit_length() + 1)  # 2^(32 - shift) buckets
    share = F.create_map(*[F.lit(x) for lang, n in texts.items() for x in (lang, int(min(1.0, each / n) * (1 << 30)))]) if texts else F.lit(None).cast("map<string,int>")
    sample = declared.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("declared")]).dropDuplicates(["declared", "h"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("declared").to_pylist(), b.column("text").to_pylist()):
                c = sums.setdefault(lang, np.zeros(1 << (32 - shift), np.int64))
                t = trigrams(text, shift)
                if len(t):
                    c += np.bincount(t, minlength=len(c))
        for lang, c in sums.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int64()), pa.array(c[i])], names=["lang", "bucket", "n"])

    rows = sample.select("declared", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    w = np.empty((1 << (32 - shift), len(languages) + 1), np.float32)
    seen = max(1024, rows["bucket"].nunique())
    for k, lang in enumerate(languages):
        c = np.zeros(len(w))
        own = rows[rows["lang"] == lang]
        c[own["bucket"].to_numpy()] = own["n"]
        w[:, k] = np.log((c + ALPHA) / (c.sum() + ALPHA * seen))
    # even mass over more trigrams than all languages have: what fits none of them is better explained by this
    w[:, -1] = -np.log(OTHER_SPREAD * seen)
    return {"languages": languages, "weights": w}


def text_scores(rows: DataFrame, model: dict, keep_text: bool = False) -> DataFrame:
    """``rows`` with text_ll array<float> (mean log-likelihoods, null without a letter) and n_trigrams; the text itself is kept if asked."""
    keep = [c for c in rows.columns if keep_text or c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    shared = rows.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches):
        w = shared.value
        shift = 33 - len(w).bit_length()
        for b in batches:
            ll, n = [], []
            for text in b.column("text"):
                t = trigrams(text.as_py() or "", shift)
                total = np.zeros(w.shape[1])
                for at in range(0, len(t), block := max(1, (1 << 20) // w.shape[1])):
                    total += w[t[at : at + block]].sum(0, dtype=np.float64)
                n.append(len(t))
                ll.append((total / len(t)).astype(np.float32) if len(t) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ll, pa.list_(pa.float32())), pa.array(n, pa.int64())], names=[*keep, "text_ll", "n_trigrams"])

    return rows.mapInArrow(run, ", ".join([*fields, "text_ll array<float>", "n_trigrams long"]))


def html_lang(html: Column) -> Column:
    """The primary language of the ``html`` element's lang attribute."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def host_domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _smooth(own: Column, base: Column) -> Column:
    """Counts shrunk to the distribution above them."""
    return F.transform(F.zip_with(own, base, lambda n, p: n + HOST_STRENGTH * p), lambda x: x / (_total(own) + HOST_STRENGTH))


def with_host_prior(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``docs``: said, host, ... -> with host_prior array<double>, the row's own declaration left out."""
    k = range(len(languages))
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in k]
    hosts = docs.where("host IS NOT NULL").groupBy("host").agg(*[F.count_if(F.col("said") == c).alias(f"n{i}") for i, c in enumerate(languages)])
    hosts = hosts.withColumn("domain", host_domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(*sums)
    overall = domains.agg(*sums).first()
    n = [(overall[f"n{i}"] or 0) + 1.0 for i in k]
    prior = F.lit([x / sum(n) for x in n])
    counts = F.array(*[F.col(f"n{i}").cast("double") for i in k])
    base = domains.select("domain", counts.alias("dn"), prior.alias("p")).select("domain", _smooth(F.col("dn"), F.col("p")).alias("base"))
    table = hosts.select("host", "domain", counts.alias("hn")).join(base, "domain").select(F.col("host").alias("of_host"), "hn", "base")
    table = materialize(table, "host-priors")
    # counted hosts that are few are broadcast, so texts stay where they are; else rows and hosts meet by a split-able sort-merge join
    most = BROADCAST_BYTES // (16 * len(languages))
    few = table.limit(most + 1).count() <= most
    j = docs.join(F.broadcast(table) if few else table, F.col("host") == F.col("of_host"), "left")
    zero = F.array_repeat(F.lit(0.0), len(languages))
    own = F.transform(F.lit(languages), lambda c: F.when(F.col("said") == c, 1.0).otherwise(0.0))
    others = F.zip_with(F.coalesce("hn", zero), own, lambda a, o: F.greatest(a - o, F.lit(0.0)))
    j = j.withColumn("hn", others).withColumn("base", F.coalesce("base", prior))
    return j.withColumn("host_prior", _smooth(F.col("hn"), F.col("base"))).drop("of_host", "hn", "base")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, model: dict | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs``: doc_id, text and, where there are any, declared, host, suffix.

    Returns doc_id, declared, host, lang, posterior, text_lang, kept, and the columns to carry (their names must not clash).
    """
    extra = [c for c in ("declared", "host", "suffix") if c not in docs.columns]
    d = docs.select("doc_id", "text", *(F.lit(None).cast("string").alias(c) if c in extra else c for c in ("declared", "host", "suffix")), *(c for c in carry if c != "text"))
    d = d.withColumn("said", primary(F.col("declared")))
    model = model or fit(d, train_rows)
    languages = model["languages"]
    cols = ["doc_id", "declared", "host", "lang", "posterior", "text_lang", "kept", *carry]
    if not languages:
        und = {"lang": F.lit("und"), "posterior": F.lit(0.0), "text_lang": F.lit("und"), "kept": F.lit(False)}
        return d.withColumns(und).select(cols)
    classes = [*languages, OTHER]
    k = len(classes)
    j = text_scores(with_host_prior(d, languages), model, "text" in carry)

    spread = lambda trust: F.lit((1 - trust) / (k - 1))
    speaks = F.lit(None).cast("string")
    for s, lang in SUFFIX_LANGUAGES.items():
        speaks = F.when(F.col("suffix") == s, F.lit(lang)).otherwise(speaks)
    j = j.withColumn("speaks", speaks)
    vote = lambda c, trust: F.transform(F.lit(classes), lambda x: F.when(F.array_contains(F.lit(languages), F.col(c)), F.log(F.when(F.col(c) == x, trust).otherwise(spread(trust)))).otherwise(0.0))
    host = F.concat(F.transform("host_prior", lambda p: F.log(F.greatest(p, F.lit(1e-6)))), F.array(F.log(F.lit(1.0 / k))))
    weight = TEMPER * F.least(F.col("n_trigrams").cast("double"), F.lit(MOST_TRIGRAMS))
    text = F.transform("text_ll", lambda x: x.cast("double") * weight)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    j = j.withColumn("joint", add(add(text, host), add(vote("said", DECLARED_TRUST), vote("speaks", SUFFIX_TRUST))))
    top = F.array_max("joint")
    mass = F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("joint")))
    names = F.lit(classes)
    pick = lambda c: F.when(F.col(c).isNull(), F.lit("und")).otherwise(F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int")))
    j = j.withColumn("lang", pick("joint")).withColumn("posterior", F.when(top.isNull(), 0.0).otherwise(1.0 / mass)).withColumn("text_lang", pick("text_ll"))
    return j.withColumn("kept", ~F.col("lang").isin("und", OTHER) & (F.col("posterior") >= KEEP)).select(cols)


def keep_identified(docs: DataFrame, declared: str, host: str, **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified, all columns unchanged, in one pass over the texts. Columns may have any names."""
    d, at = plain_names(docs)
    d = d.withColumns({"doc_id": F.col(at["doc_id"]), "text": F.col(at["text"]), "declared": F.col(at[declared]), "host": F.col(at[host])})
    rest = tuple(c for name, c in at.items() if name != "text")
    kept = identify(d, carry=("text", *rest), **options).where("kept")
    return kept.select(*["text" if name == "text" else c for name, c in at.items()]).toDF(*docs.columns)
