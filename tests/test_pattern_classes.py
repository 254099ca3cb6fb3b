"""Classes as Java reads them fastest: characters below 256 one by one, in one table, with the meaning of the ranges."""

import pytest
import regex
from pyspark.sql import functions as F

from tracewell.functions.regexes import re2_to_java, re2_to_python


def test_no_ranges_below_256_without_folding():
    for p in (r"[[:word:]]+@", r"[^[:space:][:alnum:]]{2}", r"[[:^alpha:]]", r"\d\b", r"\B\W", r"\S", r"\bé"):
        assert "-" not in re2_to_java(p), p  # as itself it is \x2d
    assert "a-z" in re2_to_java("(?i)[a-z]")  # letters fold by ranges as they did


@pytest.mark.parametrize(
    "pattern",
    [r"[[:word:]]", r"[^[:word:]]", r"\W", r"\S", r"[\S\d]", r"[^\D]", r"[\x{e0}-\x{150}]", r"[^\x{0}-\x{10ffff}]", r"[\x{0}-\x{10ffff}]", r"[\pN_a-f]", r"[^\pL\d]", r"[]a-c]", r"[z-~\x{fe}-\x{102}]", r"(?i)[j-l]", r"[^&-\[]",
     r"a\bé", r"a\Bé", r"\b ", r"\B-", r"\b-?a", r"(?i)a\bſ"],
)
def test_classes_mean_what_they_did(spark, pattern):
    texts = [chr(c) for c in range(1, 700)] + [f"a{chr(c)}a" for c in range(1, 300)] + [t for t in ("中", "😀", "\U0010ffff", "é", "aé", "a é", "-a", "a-", " a", "a ſ", "aſ")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(re2_to_java(pattern)).alias("hit"))
    python = regex.compile(re2_to_python(pattern))
    assert [r["t"] for r in df.collect() if r["hit"] != bool(python.search(r["t"]))] == []


def test_a_boundary_before_no_word_is_one_look():
    word = re2_to_java(r"\w").removeprefix("(?d)")
    assert re2_to_java(r"\bé") == rf"(?d)(?<={word})\x{{e9}}" and re2_to_java(r"\Bé") == rf"(?d)(?<!{word})\x{{e9}}"
