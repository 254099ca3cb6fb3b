"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: every source gets its weight's share of the budget (all words),
   stopped at ``max_repeats`` times its own size; the excess is reshared by
   weight until no source is above (one running sum over the sources).
2. Documents fall by hash into blocks of about ``block_docs`` documents of one
   source.  A source takes ``floor(target / size)`` whole passes over its
   blocks and, for the rest, permuted blocks until its quota of words is full;
   in the last of these, documents are taken in permuted order when they fit.
3. The exact block quotas of all sources are split among the output shards by
   a binary tree: each node deals its blocks to its two halves by hypergeometric
   draws, source after source, and the leaves hold the quotas of a shard.
4. The permuted blocks of a source go to the shards by these quotas, as
   disjoint ranges; ``position`` is the local shuffle inside a shard.

Only DataFrame functions.  Texts are reduced to word counts before the shuffles,
and documents go by (source, block), so a hot source is spread over all its
blocks.  Running sums over blocks go by ranges of the hash that orders them, so
no task holds a source's blocks either.  Only what has one row a source (targets,
quotas; a few numbers each) is ordered in one task and held in the rows of the
tree.  A draw takes as many steps as 24 standard deviations of its distribution.
All randomness is hashing of ids and ``seed``: reruns agree.

Edge cases: a null source is a source (last in order), a null text has size 0,
documents of size 0 take 0, an empty table gives an empty result; repeated rows
are mixed one by one, each in a block of its own hash; columns of any other name
are ignored by ``mix`` and kept unchanged by ``repeat``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain_names, scratch_scope, word_count

WEIGHTS, MAX_REPEATS, SHARDS, BLOCK_DOCS, SEED = (5.0, 2.0, 1.0), 3.0, 16, 512, 17
#: Blocks that one range of the ordering hash holds, on average.
RANGE_BLOCKS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sizes``: source, source_size, n_docs (one row a source) -> with rank, weight and target.

    Sources fill their cap in the order of cap / weight.  A source is capped when
    its cap does not exceed its share of what the sources before it left over.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("rank", order).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("cap", max_repeats * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    # every source not capped shares what all capped ones leave
    open_ = ~F.col("capped")
    free = F.sum(F.col("source_size").cast("double")).over(whole) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole)
    free_weight = F.sum(F.when(open_, F.col("weight")).otherwise(0.0)).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight") / free_weight)
    return s.withColumn("target", target).select("source", "source_size", "n_docs", "rank", "weight", "target")


def _uniform(*cols) -> Column:
    """A number in (0, 1) hashed from the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A draw by inverse transform: how many of ``good`` among ``total`` are in ``draws``.

    Weights start at 1 at the mode and follow the ratio of neighbouring
    probabilities both ways, up to 12 standard deviations: what lies beyond has
    less than 1e-30 of the mass, far below the resolution of ``u``. The state is
    a few numbers: first the mass of each side is summed, then the side that u
    points to is walked until it is reached.
    """
    lo = F.greatest(F.lit(0), draws - (total - good)).cast("long")
    hi = F.least(good, draws).cast("long")
    given = F.struct(total.cast("double").alias("n"), good.cast("double").alias("g"), draws.cast("double").alias("d"), lo.alias("lo"), hi.alias("hi"), u.alias("u"))

    def draw(p):
        n, g, d = p["n"], p["g"], p["d"]
        mode = F.least(p["hi"], F.greatest(p["lo"], F.floor((g + 1) * (d + 1) / (n + 2)).cast("long")))
        reach = F.ceil(12 * F.sqrt(d * g * (n - g) * (n - d) / F.greatest(n * n * (n - 1), F.lit(1.0)))).cast("long") + 12
        return _let(F.struct(mode.alias("mode"), reach.alias("reach")), lambda q: from_mode(p, q["mode"], q["reach"]))

    def from_mode(p, mode, reach):
        up = lambda k: (p["g"] - k + 1) * (p["d"] - k + 1) / (k * (p["n"] - p["g"] - p["d"] + k))  # noqa: E731  p(k) / p(k - 1)
        none = F.expr("CAST(array() AS array<bigint>)")
        above = F.when(p["hi"] > mode, F.sequence(mode + 1, F.least(p["hi"], mode + reach))).otherwise(none)
        below = F.when(p["lo"] < mode, F.sequence(mode - 1, F.greatest(p["lo"], mode - reach), F.lit(-1).cast("long"))).otherwise(none)

        def walked(steps, ratio, rest):
            start = F.struct(F.lit(1.0).alias("w"), rest.alias("rest"), mode.alias("k"))

            def step(acc, k):
                w = acc["w"] * ratio(k)
                return F.struct(w.alias("w"), (acc["rest"] - w).alias("rest"), F.when(acc["rest"] > 0, k).otherwise(acc["k"]).alias("k"))

            return F.aggregate(steps, start, step)

        rise, fall = lambda k: up(k.cast("double")), lambda k: 1 / up(k.cast("double") + 1)
        zero = F.lit(0.0)
        mass = F.struct((-walked(above, rise, zero)["rest"]).alias("more"), (-walked(below, fall, zero)["rest"]).alias("less"))

        def choose(m):
            rest = p["u"] * (1 + m["more"] + m["less"]) - 1
            return F.when(rest <= 0, mode).when(rest <= m["more"], walked(above, rise, rest)["k"]).otherwise(walked(below, fall, rest - m["more"])["k"])

        return _let(mass, choose)

    return _let(given, draw)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``quotas``: rank, units (blocks drawn from a source) -> rank, shard, units.

    One row a tree node holds the quotas of all sources; a level halves every
    node's shards and deals its units: the left half gets its share of all units
    as a multivariate hypergeometric draw, the right half the rest.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("units").cast("long").alias("units")))).alias("q")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "q")
    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        left_n = F.floor((F.col("n") + 1) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["units"])
        draws = F.floor(total * left_n / F.col("n") + 0.5).cast("long")

        def deal(acc, x):
            u = _uniform(F.lit(seed), F.lit(level), F.col("first"), x["rank"])  # noqa: B023
            dealt = lambda k: F.struct((acc["total"] - x["units"]).alias("total"), (acc["draws"] - k).alias("draws"), F.concat(acc["out"], F.array(F.struct(x["rank"].alias("rank"), k.alias("units")))).alias("out"))
            return _let(_hypergeometric(acc["total"], x["units"], acc["draws"], u), dealt)

        empty = F.expr("CAST(array() AS array<struct<rank:int,units:bigint>>)")
        dealt = F.aggregate("q", F.struct(total.alias("total"), draws.alias("draws"), empty.alias("out")), deal)["out"]

        def halves(left):
            right = F.zip_with("q", left, lambda a, b: F.struct(a["rank"].alias("rank"), (a["units"] - b["units"]).alias("units")))
            node = lambda first, n, q: F.struct(first.alias("first"), n.alias("n"), q.alias("q"))
            return F.array(node(F.col("first"), left_n, left), node(F.col("first") + left_n, F.col("n") - left_n, right))

        nodes = nodes.select(F.inline(F.when(F.col("n") > 1, _let(dealt, halves)).otherwise(F.array(F.struct("first", "n", "q")))))
    return nodes.select(F.col("first").alias("shard"), F.inline("q"))


def running(rows: DataFrame, by: str, key: Column, ties: list[str], n: str, value: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``by`` that come before in the order of the hash ``key`` and ``ties``.

    ``n`` (rows of a group, about) sets the number of ranges that the hash is cut into; a range is ordered by one task,
    and the sums before it come from the ranges' totals.
    """
    ranges = F.ceil(F.col(n) / float(RANGE_BLOCKS))
    r = rows.withColumn("key", key).withColumn("range", F.floor((F.col("key") / 2.0**64 + 0.5) * ranges)).withColumn("value", value)
    totals = r.groupBy(by, "range").agg(F.sum("value").alias("sum"))
    earlier = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(by, "range").orderBy("key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inside", F.coalesce(F.sum("value").over(inside), F.lit(0))).join(totals, [by, "range"])
    return r.withColumn("before", F.col("ahead") + F.col("inside")).drop("key", "range", "value", "inside", "ahead")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """``docs``: doc_id, source, text -> one row a document.

    doc_id, source, size, source_size, target, copies (times taken), taken
    (``copies * size``), shards array<int> and positions array<bigint> (one for each copy).
    """
    # equal rows are counted where they are and numbered, so they have hashes of their own
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").count()
    d = materialize(sizes.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("nth")), "mix-sizes")
    s = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_repeats)))).otherwise(0).cast("int")
    s = s.withColumn("passes", passes).withColumn("rest", F.round(F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))).cast("long"))
    s = materialize(s.withColumn("n_blocks", F.ceil(F.col("n_docs") / float(block_docs)).cast("int")), "mix-targets")
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    # a source is one row: a document's source only decides its number of blocks
    of = ["s.rank", "s.source_size", "s.target", "s.passes", "s.rest", "s.n_blocks"]
    d = d.alias("d").join(s.alias("s"), same).select("d.doc_id", "d.source", "d.size", "d.nth", *of, F.pmod(F.xxhash64(F.lit(seed), "d.doc_id", "d.nth"), F.col("s.n_blocks")).cast("int").alias("block"))

    # blocks in permuted order, with the words before each: where the rest of the quota ends
    blocks = d.groupBy("rank", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("passes", "rest", "n_blocks")))
    blocks = running(blocks, "rank", F.xxhash64(F.lit(seed + 1), "rank", "block"), ["block"], "n_blocks", F.col("words"))
    room = F.greatest(F.col("rest") - F.col("before"), F.lit(0)).cast("long")
    blocks = materialize(blocks.select("rank", "block", "passes", "words", "n_blocks", F.least(room, "words").alias("room")), "mix-blocks")

    # units (pass, block) of each source, dealt to the shards
    units = blocks.select("rank", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"), "passes", "room", "n_blocks").where("pass < passes OR room > 0")
    quotas = materialize(split_quotas(units.groupBy("rank").agg(F.count("*").alias("units")), shards, seed), "mix-quotas")
    upto = Window.partitionBy("rank").orderBy("shard")
    ranges = quotas.withColumn("upto", F.sum("units").over(upto)).groupBy("rank").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    units = running(units, "rank", F.xxhash64(F.lit(seed + 2), "rank", "pass", "block"), ["pass", "block"], "n_blocks", F.lit(1).cast("long"))
    shard = F.size(F.filter("upto", lambda x: x <= F.col("before"))).cast("int")
    units = units.join(ranges, "rank").select("rank", "block", "pass", shard.alias("shard"))
    by_block = units.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("units"))
    blocks = materialize(blocks.drop("n_blocks").join(by_block, ["rank", "block"], "left"), "mix-units")

    # documents of a block in permuted order; in the last one those that still fit are taken
    j = d.join(blocks.select("rank", "block", "words", "room", "units"), ["rank", "block"])
    part = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    item = F.struct(F.xxhash64(F.lit(seed + 3), "doc_id", "size", "nth").alias("key"), "doc_id", "size", "nth")
    last = j.where(part).groupBy("rank", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("room").alias("room"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    start = F.struct(F.col("room").alias("room"), F.expr(f"CAST(array() AS array<struct<doc_id:{kind},size:bigint,nth:bigint,some:boolean>>)").alias("out"))

    def fit(acc, x):
        takes = x["size"] <= acc["room"]
        took = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["nth"].alias("nth"), takes.alias("some"))
        return F.struct((acc["room"] - F.when(takes, x["size"]).otherwise(F.lit(0).cast("long"))).alias("room"), F.concat(acc["out"], F.array(took)).alias("out"))

    fitted = last.select("rank", "block", F.inline(F.aggregate("items", start, fit)["out"]))
    cols = ["rank", "block", "source", "doc_id", "size", "nth", "source_size", "target", "passes", "units"]
    whole = j.where(~part).select(*cols, (F.col("room") > 0).alias("some"))
    info = j.where(part).groupBy("rank", "block").agg(*(F.first(c).alias(c) for c in ("source", "source_size", "target", "passes", "units")))
    some = fitted.join(info, ["rank", "block"]).select(*cols, "some")
    out = whole.unionByName(some)
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("some").cast("int")).otherwise(0)
    used = F.filter("units", lambda u: (F.col("size") > 0) & ((u["pass"] < F.col("passes")) | F.col("some")))
    out = out.withColumn("copies", copies).withColumn("used", F.coalesce(used, F.expr("CAST(array() AS array<struct<pass:int,shard:int>>)")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.transform("used", lambda u: u["shard"]).alias("shards"),
        F.transform("used", lambda u: F.xxhash64(F.lit(seed + 4), u["shard"], u["pass"], F.col("doc_id"), F.col("nth"))).alias("positions"),
    )


def repeat(docs: DataFrame, max_repeats: float = MAX_REPEATS, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged. Columns may have any names.

    Rows of one id, source and size are alike to the mix; in the order of their texts the first get the most copies.
    """
    d, at = plain_names(docs)
    doc_id, source, text = (F.col(at[c]) for c in ("doc_id", "source", "text"))
    with scratch_scope():
        mixed = mix(d.select(doc_id.alias("doc_id"), source.alias("source"), text.alias("text")), max_repeats=max_repeats, **options)
        # how many of the alike rows are taken once or more, twice or more, ...
        rows_with = F.array(*[F.count_if(F.col("copies") >= c) for c in range(1, math.ceil(max_repeats) + 1)])
        taken = mixed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"), rows_with.alias("rows_with")).where("rows_with[0] > 0")
        taken = materialize(taken, "mix-copies", stays=True)
    d = d.withColumn("words", word_count(text))

    def copied(part: DataFrame, nth: Column) -> DataFrame:
        same = doc_id.eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
        j = d.join(part, same).withColumn("nth", nth)
        copies = F.size(F.filter("rows_with", lambda n: n >= F.col("nth")))
        return j.withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), "copies"))).select(*at.values())

    out = copied(taken.where("rows = 1"), F.lit(1))
    several = taken.where("rows > 1")
    if not several.isEmpty():
        out = out.union(copied(several, F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64(text)))))
    return out.toDF(*docs.columns)
