"""JSON documents of calls: canonical form, hash, token estimate, truncation.

These are what a call goes through before it is stored: redact, hash, estimate, truncate.
"""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Number(str):
    """A number as it was written."""


def _strict(name: str):
    raise ValueError(name)


_ESCAPES = {ord("<"): "\\u003c", ord(">"): "\\u003e", ord("&"): "\\u0026", 0x2028: "\\u2028", 0x2029: "\\u2029"}
_ESCAPED, _HALF = re.compile("[<>&\u2028\u2029]"), re.compile("[\ud800-\udfff]")


class _AsWritten(json.JSONDecoder):
    """Reads JSON with its numbers as they are written; tasks make their own."""

    def __init__(self):
        json.JSONDecoder.__init__(self, parse_int=_Number, parse_float=_Number, parse_constant=_strict)

    def __reduce__(self):
        return _AsWritten, ()


_AS_WRITTEN = _AsWritten()
#: Made once: ``json.dumps`` makes a writer a call.
_PLAIN = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)
_SORTED = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True, allow_nan=False)


def _member(v) -> str:
    if isinstance(v, _Number):
        return v
    if isinstance(v, str):
        return encode_basestring(v if v.isascii() else _HALF.sub("\ufffd", v))  # half a surrogate pair is no character
    if isinstance(v, dict):
        return "{" + ",".join([f"{_member(k)}:{_member(v[k])}" for k in sorted(v)]) + "}"
    if isinstance(v, list):
        return "[" + ",".join([_member(x) for x in v]) + "]"
    return json.dumps(v)


def _escaped(text: str) -> str:
    """JSON text whose strings (nothing else has them) show these characters as escapes."""
    return text.translate(_ESCAPES) if _ESCAPED.search(text) else text


def _write(v) -> str:
    return _escaped(_member(v))


def canonical_text(document: str | None) -> str | None:
    """Keys sorted, no blanks, numbers as written, ``< > &`` escaped; what is no JSON stays as it is; blank is empty."""
    if document is None or not document.strip(" \t\r\n"):
        return None if document is None else ""
    try:
        return _write(_AS_WRITTEN.raw_decode(document.lstrip(" \t\r\n"))[0])
    except (ValueError, RecursionError):
        return document


def canonical(document: Column) -> Column:
    """``canonical_text`` of a column: equal documents give equal texts."""

    @F.arrow_udf("string")
    def run(docs: pa.Array) -> pa.Array:
        return pa.array([canonical_text(d) for d in docs.to_pylist()], pa.string())

    return run(document)


def _hash(canonical: Column) -> Column:
    c = F.coalesce(canonical, F.lit(""))
    return F.when(c == "", "").otherwise(F.sha2(c, 256))


def document_hash(document: Column) -> Column:
    """SHA-256 of the canonical form; of an empty or missing document the empty text."""
    return _hash(canonical(document))


def written(value) -> tuple[str, str]:
    """(the JSON text of a parsed value, that text's canonical form)."""
    text = _PLAIN.encode(value)
    try:
        return text, _escaped(_SORTED.encode(value))
    except ValueError:  # no number
        return text, canonical_text(text)


#: Members of a definition; all but the name are left out of its hash where they say nothing.
DEFINITION = ("kind", "name", "title", "description", "inputSchema", "outputSchema", "annotations", "arguments", "uri", "mimeType")


def definition_hash(definition: Column) -> Column:
    """``sha256:`` and the hash of a tool's, prompt's or resource's JSON definition, whatever its key order and empty members.

    Members that are no part of a definition don't count; a missing name is an empty one; what is no JSON object has none (null).
    """

    @F.pandas_udf("string")
    def kept(docs: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                d = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_strict)
            except (ValueError, RecursionError):
                return None
            if not isinstance(d, dict):
                return None
            said = {k: d[k] for k in DEFINITION if k in d and d[k] not in (None, "", {}, [])}
            return _write({"name": "", **said})

        return docs.map(one, na_action="ignore")

    return F.concat(F.lit("sha256:"), F.sha2(kept(definition), 256))


def tokens_estimate(*documents: Column) -> Column:
    """A quarter of the documents' bytes."""
    size = sum((F.coalesce(F.octet_length(d), F.lit(0)) for d in documents), F.lit(0))
    return F.floor(size / 4).cast("long")


def truncated(document: Column, most_bytes: int) -> tuple[Column, Column]:
    """(document of at most so many bytes wrapped in an object that says so, was it cut): the result stays JSON."""
    from ..detect.scan import cut_bytes

    longer = F.octet_length(document) > most_bytes if most_bytes > 0 else F.lit(False)
    head = F.struct(F.octet_length(document).alias("_bytes"), F.lit(True).alias("_truncated"), cut_bytes(document, most_bytes).alias("head"))
    return F.when(longer, F.to_json(head)).otherwise(document), F.coalesce(longer, F.lit(False))


def prepare(calls: DataFrame, most_bytes: int, patterns=None) -> DataFrame:
    """``calls``: args_json, result_json, ... -> as they are stored: secrets redacted, hashed, tokens estimated, then cut."""
    from ..detect.secrets import REDACTIONS, redacted_json

    both = {c: redacted_json(F.col(f"{c}_json"), REDACTIONS if patterns is None else patterns) for c in ("args", "result")}
    c = calls.withColumns({f"_{k}": v for k, v in both.items()})
    c = c.withColumns({"args_json": F.col("_args.text"), "result_json": F.col("_result.text"), "args_hash": _hash(F.col("_args.canonical")), "result_hash": _hash(F.col("_result.canonical"))})
    c = c.withColumn("tokens_est", tokens_estimate(F.col("args_json"), F.col("result_json"))).drop("_args", "_result")
    args, _ = truncated(F.col("args_json"), most_bytes)
    result, cut = truncated(F.col("result_json"), most_bytes)
    return c.withColumn("result_truncated", cut).withColumns({"args_json": args, "result_json": result})


# --- walks of JSON documents ----------------------------------------------------------------------


def walk_strings(value, path: str):
    """(where, text, is_key) of every string in a parsed document, keys before what they hold, members by name."""
    todo = [(path, value)]
    while todo:
        where, v = todo.pop()
        if isinstance(v, str):
            yield where, v, False
        elif isinstance(v, list):
            todo += [(f"{where}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            for k in sorted(v):
                yield f"{where} (a key)", k, True
            todo += [(f"{where}.{k}", v[k]) for k in sorted(v, reverse=True)]


def json_strings(rows: DataFrame, documents: dict[str, str], keep: list[str]) -> DataFrame:
    """A row for each string, keys too, of the JSON columns ``documents`` (column: name of its root): the columns ``keep``, where, text, is_key.

    Documents of any depth and width; one that does not parse, or is null, has no strings.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    names = [*keep, "where", "text", "is_key"]

    def run(batches):
        for b in batches:
            held, at = [], []
            for column, root in documents.items():
                for i, doc in enumerate(b.column(column).to_pylist()):
                    try:
                        value = json.loads(doc) if doc else None
                    except ValueError:
                        continue
                    for row in walk_strings(value, root):
                        held.append(row)
                        at.append(i)
            for k in range(0, len(held), 10_000):
                some = list(zip(*held[k : k + 10_000]))
                kept = b.select(keep).take(pa.array(at[k : k + 10_000])).columns if keep else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(some[0], pa.string()), pa.array(some[1], pa.string()), pa.array(some[2], pa.bool_())], names=names)

    return rows.select(*keep, *(c for c in documents if c not in keep)).mapInArrow(run, ", ".join([*fields, "where string", "text string", "is_key boolean"]))


def flat_strings(document: Column) -> Column:
    """All strings of a JSON document, keys too, each on a line of its own; empty for what is no document."""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(doc):
            try:
                return "".join(f"{text}\n" for _, text, _ in walk_strings(json.loads(doc), ""))
            except (TypeError, ValueError):
                return ""

        return docs.map(one)

    return run(document)


def wire_result(result: Column) -> Column:
    """struct<is_error, text> of a tool's result as it travels: its texts and embedded resources, one a line, else its structured content; null if it is no JSON object."""
    schema = "struct<isError: boolean, content: array<struct<type: string, text: string, resource: struct<text: string>>>, structuredContent: string>"
    r = F.from_json(result, schema)
    said = lambda c: F.when((c["type"] == "text") & (c["text"] != ""), c["text"]).when(c["resource"]["text"] != "", c["resource"]["text"])
    parts = F.filter(F.transform(F.coalesce(r["content"], F.array().cast("array<struct<type: string, text: string, resource: struct<text: string>>>")), said), lambda x: x.isNotNull())
    text = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.coalesce(r["structuredContent"], F.lit("")))
    whole = F.schema_of_variant(F.try_parse_json(result)).startswith("OBJECT")
    return F.when(whole, F.struct(F.coalesce(r["isError"], F.lit(False)).alias("is_error"), text.alias("text")))
