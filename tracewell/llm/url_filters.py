"""URL filters: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host.  Each level of the address is a
beta-binomial whose prior is the posterior mean of the level above it, weighted
by a strength estimated from all groups of that level (method of moments over
the intra-class correlation): all pages -> suffix -> registered domain -> host.
A page is blocked when the lower bound of its host's posterior bad rate,
``mean - z * sd``, exceeds ``threshold``.

Only DataFrame functions; hosts are pre-aggregated before anything is joined,
and the one wide join (pages to hosts) is a plain equi-join that adaptive
execution splits where a host is hot.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no
rule and gets the reputation of the empty host (counted like any other). Null
or repeated keys in the outcomes: null outcomes are skipped, repeats of one key
count once, as bad if any is. Repeated pages are judged one by one. With no
outcome at all every rate is the neutral prior ``0.5 * threshold`` and nothing
is blocked. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (pattern ``host/path``, verdict). Fixed values of the query's contract.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Second-level labels that act as a suffix below a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z, THRESHOLD = 1.0, 0.5
#: Bounds of a level's prior strength in pseudo-outcomes.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule (ties: first given), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain): the last label, or the last two below a country label; one label more for the domain. Numeric addresses are their own domain."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    take = F.when(second, 2).otherwise(1)
    numeric = host.rlike(r"^[0-9.]+(:[0-9]+)?$")
    join = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(numeric, F.lit("")).otherwise(join(take)), F.when(numeric, host).otherwise(join(take + 1))


def _strength(groups: DataFrame) -> float:
    """1/rho - 1 of the groups (n, k), rho by analysis of variance; bounded."""
    rate = F.col("k") / F.col("n")
    g = groups.where("n > 0")
    s = g.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * rate).alias("kk"), F.sum(F.col("k") * (1 - rate)).alias("within")).first()
    if not s["m"] or s["m"] < 2 or s["n"] <= s["m"]:
        return MAX_STRENGTH
    mean = s["k"] / s["n"]
    between = max(0.0, s["kk"] - s["n"] * mean * mean) / (s["m"] - 1)
    within = s["within"] / (s["n"] - s["m"])
    n0 = (s["n"] - s["nn"] / s["n"]) / (s["m"] - 1)
    top, bottom = between - within, between + (n0 - 1) * within
    rho = top / bottom if bottom > 0 else 0.0
    return min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / rho - 1)) if rho > 0 else MAX_STRENGTH


def host_reputation(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``counts``: host, n (labelled pages), k (bad ones) -> host, n, k, a, b of its beta posterior."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = counts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = total["k"] / total["n"] if total["n"] else 0.5 * threshold
    s_host, s_domain, s_suffix = (_strength(x) for x in (hosts, domains, suffixes))
    shrunk = lambda t, prior, s: (F.col(f"{t}.k") + prior * s) / (F.col(f"{t}.n") + s)
    s = suffixes.alias("s").select(F.col("suffix"), shrunk("s", F.lit(overall), s_suffix).alias("p"))
    d = domains.alias("d").join(s, "suffix").select("suffix", "domain", shrunk("d", F.col("p"), s_domain).alias("p"))
    h = hosts.join(d, ["suffix", "domain"])
    return h.select("host", "n", "k", (F.col("k") + s_host * F.col("p")).alias("a"), (F.col("n") - F.col("k") + s_host * (1 - F.col("p"))).alias("b"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """``pages``: page_id, url, outcome_key; ``outcomes``: outcome_key, bad boolean -> the verdict of each page.

    Columns: page_id, host, path, rule, verdict, labelled (outcomes of the host), bad_rate, lower_bound.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", "outcome_key", host.alias("host"), path.alias("path"))
    o = outcomes.where("outcome_key IS NOT NULL AND bad IS NOT NULL").groupBy("outcome_key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = p.join(o, "outcome_key", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    rep = host_reputation(materialize(counts, "host-counts"), threshold)  # read by five actions
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    rep = rep.select("host", F.col("n").alias("labelled"), mean.alias("bad_rate"), F.greatest(mean - z * sd, F.lit(0.0)).alias("lower_bound"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r, verdict in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(verdict)).otherwise(by_rule)
    by_host = F.when(F.col("lower_bound") > threshold, "block").otherwise("allow")
    return p.select("page_id", "host", "path", rule.alias("rule")).join(rep, "host").select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "labelled", F.round("bad_rate", 6).alias("bad_rate"), F.round("lower_bound", 6).alias("lower_bound"))
