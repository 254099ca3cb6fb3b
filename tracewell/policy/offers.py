"""Which of a server's tools an agent is offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import glob_to_java


def _patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(globs that offer, globs that hide): the latter are marked by an exclamation mark."""
    said = [p.strip() for p in patterns]
    if any(not p.removeprefix("!").strip() for p in said):
        raise ValueError("a pattern is empty")
    return [p for p in said if not p.startswith("!")], [p[1:].strip() for p in said if p.startswith("!")]


def offered(filters: dict[str, list[str]]) -> Column:
    """Is the tool ``tool_name`` of ``upstream`` offered? A pattern that hides it decides; else one that offers it, or that there are none of these."""
    out = F.lit(True)
    for upstream, patterns in filters.items():
        shown, hidden = _patterns(patterns)
        hit = lambda globs: F.col("tool_name").rlike("|".join(f"(?:{glob_to_java(g)})" for g in globs)) if globs else F.lit(False)
        out = F.when(F.col("upstream") == upstream, ~hit(hidden) & (hit(shown) if shown else F.lit(True))).otherwise(out)
    return out


def unmatched(tools: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """``tools``: upstream, tool_name -> upstream, pattern: the patterns that match none of their server's tools, likely mistakes."""
    rows = [(u, p.strip()) for u, ps in filters.items() for p in ps]
    hits = [F.count_if((F.col("upstream") == u) & F.col("tool_name").rlike(glob_to_java(p.removeprefix("!").strip()))).alias(f"n{i}") for i, (u, p) in enumerate(rows)]
    if not rows:
        return tools.sparkSession.createDataFrame([], "upstream string, pattern string")
    n = tools.agg(*hits)
    each = F.array(*[F.struct(F.lit(u).alias("upstream"), F.lit(p).alias("pattern"), F.col(f"n{i}").alias("n")) for i, (u, p) in enumerate(rows)])
    return n.select(F.inline(each)).where("n = 0").drop("n")
