"""Integrity: hash chains, anchors, Merkle roots, pins and registries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.log import CALL_COLUMNS

#: Hash before the first link of a chain.
GENESIS = ""
#: What a link hashes, in order: every stored column.
LINKED = (
    "seq", "id", "session_id", "ts_ms", "upstream", "tool", "args_json", "args_hash", "decision", "rule_id", "reason", "result_json", "result_hash",
    "is_error", "duration_ms", "tokens_est", "result_truncated", "error", "shadow", "labels", "catalog_hash",
)


def content(columns: list[str]) -> Column:
    """The hashed text of a call without its link: a JSON object of the fields in fixed order, those not in ``columns`` at their defaults."""

    def field(name: str) -> Column:
        kind, default = CALL_COLUMNS[name]
        if name == "labels":
            return F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",") if name in columns else F.lit("")
        value = F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    out = F.to_json(F.struct(*[field(n).alias(n) for n in LINKED]), {"ignoreNullFields": "false"})
    for char, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(escaped))
    return out


def link_hash(prev: Column, columns: list[str]) -> Column:
    return F.sha2(F.concat(prev, F.lit("\n"), content(columns)), 256)


def build(calls: DataFrame, chain: str = "session_id") -> DataFrame:
    """Calls with seq, prev_hash and row_hash, one chain for each value of ``chain``, numbered from 1 in order of time and id.

    Hashing a chain is serial by nature; chains run side by side and each streams
    through its task in sorted order, holding one hash.
    """
    return append(calls, None, chain)


def append(calls: DataFrame, heads: DataFrame | None, chain: str = "session_id") -> DataFrame:
    """``build`` going on from the stored ``heads`` (chain, seq, row_hash, once a chain): appending in parts links what one build links.

    Calls are numbered after the head whatever their time; a chain without a head begins.
    """
    names = [c for c in calls.columns if c not in ("seq", "prev_hash", "row_hash")]
    order = Window.partitionBy(chain).orderBy("ts_ms", "id")
    numbered = calls.select(*names, F.row_number().over(order).cast("long").alias("seq"))
    if heads is None:
        begun = numbered.withColumn("_head", F.lit(GENESIS))
    else:
        h = heads.select(F.col(chain).alias("_chain"), F.col("seq").alias("_seq"), F.col("row_hash").alias("_head"))
        begun = numbered.join(h, F.col(chain) == F.col("_chain"), "left").withColumn("seq", F.col("seq") + F.coalesce("_seq", F.lit(0))).withColumn("_head", F.coalesce("_head", F.lit(GENESIS))).drop("_chain", "_seq")
    text = begun.withColumn("_content", content(numbered.columns)).repartition(chain).sortWithinPartitions(chain, "seq")
    out = [*names, "seq", "prev_hash", "row_hash"]

    def run(batches):
        key, prev, none = None, GENESIS, True
        for b in batches:
            before, own = [], []
            for k, t, head in zip(b.column(chain).to_pylist(), b.column("_content").to_pylist(), b.column("_head").to_pylist()):
                if none or k != key:
                    key, prev, none = k, head, False
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\n{t}".encode("utf-8", "surrogatepass")).hexdigest()
                own.append(prev)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out[:-2]), pa.array(before, pa.string()), pa.array(own, pa.string())], names=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(out[:-2]).schema) + ", prev_hash string, row_hash string"
    return text.mapInArrow(run, schema)


def verify(chained: DataFrame, chain: str = "session_id", cut: DataFrame | None = None) -> DataFrame:
    """Problems of chained calls: chain, id, seq, problem (order, gap, link, content).

    ``cut``: chain, seq, hash of the last link that retention took from a chain; it stands before the chain's first row.
    A row's hash depends only on the stored link, so contents are checked row by row in parallel; links and gaps
    compare neighbours. Calls without seq were written before the chain and are no part of it.
    """
    names = chained.columns
    c = chained.where("seq IS NOT NULL")
    if cut is not None:
        c = c.join(cut.select(chain, F.col("seq").alias("_cut_seq"), F.col("hash").alias("_cut_hash")), chain, "left")
    else:
        c = c.withColumns({"_cut_seq": F.lit(0).cast("long"), "_cut_hash": F.lit(GENESIS)})
    w = Window.partitionBy(chain).orderBy("seq", "id")
    c = c.withColumn("_seq", F.coalesce(F.lag("seq").over(w), "_cut_seq", F.lit(0))).withColumn("_hash", F.coalesce(F.lag("row_hash").over(w), "_cut_hash", F.lit(GENESIS)))
    problem = F.array(
        F.when(F.col("seq") <= F.col("_seq"), "order"),
        F.when(F.col("seq") > F.col("_seq") + 1, "gap"),
        F.when(~F.col("prev_hash").eqNullSafe(F.col("_hash")), "link"),
        F.when(~F.col("row_hash").eqNullSafe(link_hash(F.coalesce("prev_hash", F.lit("")), names)), "content"),
    )
    return c.select(chain, "id", "seq", F.explode(F.filter(problem, lambda p: p.isNotNull())).alias("problem"))


def verify_report(chained: DataFrame, chain: str = "session_id", cut: DataFrame | None = None) -> DataFrame:
    """One row a chain: checked, legacy (calls without seq), problems, head_seq and head_hash."""
    found = verify(chained, chain, cut).groupBy(chain).agg(F.count("*").alias("problems"))
    rows = chained.groupBy(chain).agg(F.count("seq").alias("checked"), F.count_if(F.col("seq").isNull()).alias("legacy"), F.max("seq").alias("head_seq"), F.max_by("row_hash", "seq").alias("head_hash"))
    return rows.join(found, chain, "left").withColumn("problems", F.coalesce("problems", F.lit(0)))


def head_links(chained: DataFrame, chain: str = "session_id", cut: DataFrame | None = None) -> DataFrame:
    """The newest link of each chain: seq and row_hash; of a chain cut to nothing the link it was cut at."""
    heads = chained.where("seq IS NOT NULL").groupBy(chain).agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))
    if cut is None:
        return heads
    c = cut.select(chain, F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
    return heads.join(c, chain, "full_outer").select(chain, F.coalesce("seq", "_seq").alias("seq"), F.coalesce("row_hash", "_hash").alias("row_hash"))


def verify_anchors(chained: DataFrame, anchors: DataFrame, chain: str = "session_id", cut: DataFrame | None = None) -> DataFrame:
    """``anchors``: chain, seq, hash; ``cut``: as in ``verify`` -> chain, seq, hash, status, problem.

    ok; contradiction (anchors of one seq differ: one was not taken from this chain); conflict (another call stands there);
    pruned (at or before the cut, no longer checked: a problem only if it is the chain's only anchor); beyond (the chain ends
    before it). Every chain is judged by its own rows; a chain of which nothing is left has only what was cut from it.
    """
    given = anchors.select(F.col(chain).alias("_chain"), "seq", "hash").distinct()
    ends = chained.where("seq IS NOT NULL").groupBy(F.col(chain).alias("_chain")).agg((F.min("seq") - 1).alias("_lo"), F.max("seq").alias("_hi"))
    each = given.groupBy("_chain", "seq").agg((F.count("*") > 1).alias("_several"))
    alone = given.groupBy("_chain").agg((F.count("*") == 1).alias("_alone"))
    links = chained.select(F.col(chain).alias("_chain"), "seq", "row_hash")
    a = given.join(each, ["_chain", "seq"]).join(alone, "_chain").join(ends, "_chain", "left").join(links, ["_chain", "seq"], "left")
    if cut is not None:
        a = a.join(cut.select(F.col(chain).alias("_chain"), F.col("seq").alias("_cut_seq"), F.col("hash").alias("_cut_hash")), "_chain", "left")
    else:
        a = a.withColumns({"_cut_seq": F.lit(None).cast("long"), "_cut_hash": F.lit(None).cast("string")})
    lo, hi = F.coalesce("_cut_seq", "_lo", F.lit(0)), F.coalesce("_hi", "_cut_seq", F.lit(0))
    stands = F.coalesce(((F.col("seq") == F.col("_cut_seq")) & (F.col("hash") == F.col("_cut_hash"))) | (F.col("row_hash") == F.col("hash")), F.lit(False))
    status = F.when(F.col("_several"), "contradiction").when(stands, "ok").when(F.col("seq") <= lo, "pruned").when(F.col("seq") > hi, "beyond").otherwise("conflict")
    problem = F.col("status").isin("contradiction", "conflict", "beyond") | ((F.col("status") == "pruned") & F.col("_alone"))
    return a.withColumn("status", status).select(F.col("_chain").alias(chain), "seq", "hash", "status", problem.alias("problem"))


def merkle_root(leaves: list[bytes]) -> str:
    """RFC 6962 tree head of hashed leaves. Pairing level by level, the odd one carried up, gives the split at the largest power of two."""
    if not leaves:
        return hashlib.sha256(b"").hexdigest()
    level = leaves
    while len(level) > 1:
        paired = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = paired + ([level[-1]] if len(level) % 2 else [])
    return level[0].hex()


def merkle_roots(files: DataFrame) -> DataFrame:
    """``files``: skill, path, kind, hash -> skill, n_files, root of its sorted files."""
    f = files.repartition("skill").sortWithinPartitions("skill", "path").select("skill", F.sha2(F.concat(F.lit(b"\x00"), F.col("path").cast("binary"), F.lit(b"\x00"), F.col("kind").cast("binary"), F.lit(b"\x00"), F.col("hash").cast("binary")), 256).alias("leaf"))

    def run(batches):
        key, n, stack = None, 0, []  # stack: (size, hash) of complete subtrees, sizes falling

        def root():
            if not stack:
                return hashlib.sha256(b"").hexdigest()
            h = stack[-1][1]
            for _, left in reversed(stack[:-1]):
                h = hashlib.sha256(b"\x01" + left + h).digest()
            return h.hex()

        for b in batches:
            out = []
            for k, leaf in zip(b.column("skill").to_pylist(), b.column("leaf").to_pylist()):
                if n and k != key:
                    out.append((key, n, root()))
                    n, stack = 0, []
                key, n = k, n + 1
                size, h = 1, bytes.fromhex(leaf)
                while stack and stack[-1][0] == size:
                    h, size = hashlib.sha256(b"\x01" + stack.pop()[1] + h).digest(), 2 * size
                stack.append((size, h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["skill", "n_files", "root"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n], pa.int64()), pa.array([root()], pa.string())], names=["skill", "n_files", "root"])

    return f.mapInArrow(run, "skill string, n_files long, root string")


def pin_check(offered: DataFrame, pinned: DataFrame) -> DataFrame:
    """Both: upstream, ref, hash -> upstream, ref, status: pinned, new, changed or removed."""
    o, p = offered.alias("o"), pinned.alias("p")
    j = o.join(p, (F.col("o.upstream") == F.col("p.upstream")) & (F.col("o.ref") == F.col("p.ref")), "full_outer")
    status = F.when(F.col("p.ref").isNull(), "new").when(F.col("o.ref").isNull(), "removed").when(F.col("o.hash") == F.col("p.hash"), "pinned").otherwise("changed")
    return j.select(F.coalesce("o.upstream", "p.upstream").alias("upstream"), F.coalesce("o.ref", "p.ref").alias("ref"), status.alias("status"))


def registry_compare(here: DataFrame, registry: DataFrame) -> DataFrame:
    """Both: ref, hash -> ref, status: same, differs, only-here or only-in-registry."""
    j = here.alias("h").join(registry.alias("r"), "ref", "full_outer")
    status = F.when(F.col("r.hash").isNull(), "only-here").when(F.col("h.hash").isNull(), "only-in-registry").when(F.col("h.hash") == F.col("r.hash"), "same").otherwise("differs")
    return j.select("ref", status.alias("status"))


def registry_latest(log: DataFrame) -> DataFrame:
    """``log``: index, path, hash -> path, hash of its last record, publications."""
    return log.groupBy("path").agg(F.max_by("hash", "index").alias("hash"), F.count("*").alias("published"))


def registry_verify(log: DataFrame, files: DataFrame) -> DataFrame:
    """``log``: place (from 0), index, path, hash; ``files``: path, hash -> subject, problem.

    moved (a record names another place than its own), gone (logged, no such file), changed (not the last hash logged for it),
    by-hand (a file that was never logged).
    """
    moved = log.where(~F.col("index").eqNullSafe(F.col("place"))).select(F.col("place").cast("string").alias("subject"), F.lit("moved").alias("problem"))
    last = registry_latest(log.select(F.col("place").alias("index"), "path", "hash")).select("path", F.col("hash").alias("logged"), F.lit(True).alias("known"))
    both = last.join(files.select("path", "hash", F.lit(True).alias("there")), "path", "full_outer")
    problem = F.when(F.col("known").isNull(), "by-hand").when(F.col("there").isNull(), "gone").when(~F.col("hash").eqNullSafe(F.col("logged")), "changed")
    return moved.union(both.select(F.col("path").alias("subject"), problem.alias("problem")).where("problem IS NOT NULL"))


def _pieces(start: int, stop: int) -> list[tuple[int, int]]:
    """(start, size) of the complete subtrees that make up the leaves from ``start`` to ``stop``: aligned powers of two."""
    out = []
    while start < stop:
        size = start & -start if start else 1 << (stop.bit_length() - 1)
        while size > stop - start:
            size >>= 1
        out.append((start, size))
        start += size
    return out


def frontier(leaves: DataFrame, size: int, before: list[tuple[int, str]] = (), block: int = 1024) -> list[tuple[int, str]] | None:
    """``leaves``: place (from 0, each once), leaf (hex) -> the heads of the complete subtrees over the first ``size`` leaves.

    The frontier is as long as ``size`` has one bits. It is all that has to be kept of a log: ``before``, the frontier of
    a shorter prefix, is gone on from, and only the leaves after it are hashed. Each round replaces whole blocks, a
    power of two, by their heads, so no task holds more than a block. A log shorter than ``size`` has none.
    """
    if block & (block - 1) or block < 2:
        raise ValueError("block is a power of two")
    known = sum(n for n, _ in before)
    if known > size:
        raise ValueError("the frontier gone on from is of a longer log")
    pieces = _pieces(known, size)

    def run(table: pa.Table) -> pa.Table:
        nodes = sorted(zip(table.column("place").to_pylist(), table.column("leaf").to_pylist()))
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int64()), "place": pa.array([nodes[0][0] // block], pa.int64()), "leaf": [merkle_root([bytes.fromhex(h) for _, h in nodes])], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    heads = {}
    if pieces:
        of = F.element_at(F.filter(F.lit([s for s, _ in pieces]), lambda s: s <= F.col("place")), -1).cast("long")
        level = leaves.where((F.col("place") >= known) & (F.col("place") < size)).select(of.alias("piece"), (F.col("place") - of).cast("long").alias("place"), "leaf", F.lit(1).cast("long").alias("n"))
        left = max(n for _, n in pieces)
        while left > 1:
            level = level.groupBy("piece", F.floor(F.col("place") / block).alias("_block")).applyInArrow(run, "piece long, place long, leaf string, n long")
            left = -(-left // block)
        heads = {r["piece"]: (r["n"], r["leaf"]) for r in level.collect()}  # a row a piece
    stack = list(before)
    for start, n in pieces:
        if heads.get(start, (0, ""))[0] != n:
            return None
        stack.append((n, heads[start][1]))
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            n, h = stack.pop()
            stack[-1] = (2 * n, merkle_root([bytes.fromhex(stack[-1][1]), bytes.fromhex(h)]))
    return stack


def frontier_root(heads: list[tuple[int, str]]) -> str:
    """The RFC 6962 head of a frontier."""
    if not heads:
        return merkle_root([])
    root = bytes.fromhex(heads[-1][1])
    for _, left in reversed(heads[:-1]):
        root = hashlib.sha256(b"\x01" + bytes.fromhex(left) + root).digest()
    return root.hex()


def log_head(leaves: DataFrame, size: int, block: int = 1024) -> DataFrame:
    """size, root: RFC 6962 head over the first ``size`` leaves; no row if the log is shorter."""
    heads = frontier(leaves, size, block=block)
    rows = [] if heads is None else [(size, frontier_root(heads))]
    return leaves.sparkSession.createDataFrame(rows, "size long, root string")


def noted_heads(leaves: DataFrame, noted: list[tuple[int, str]], block: int = 1024) -> list[tuple[int, str, str]]:
    """(size, root, problem) of each noted head: empty if the log still begins with the records it was taken over, else cut or rewritten.

    Heads are looked at from the shortest on, each going on from the frontier of the one before: every leaf is hashed once.
    """
    n = leaves.agg(F.max("place")).first()[0]
    length = 0 if n is None else n + 1
    out, heads = [], []
    for size, root in sorted(set(noted)):
        if size > length:
            out.append((size, root, "cut"))
            continue
        heads = frontier(leaves, size, heads, block) or []
        out.append((size, root, "" if sum(k for k, _ in heads) == size and frontier_root(heads) == root else "rewritten"))
    return out


def registry_report(log: DataFrame, files: DataFrame, head: tuple[int, str] | None = None, noted: list[tuple[int, str]] = ()) -> DataFrame:
    """``log``: place, index, path, hash, leaf; ``files``: path, hash; ``head``: what the registry says its head is -> subject, problem.

    What ``registry_verify`` finds; head (not the head of the log); cut and rewritten (see ``noted_heads``).
    """
    leaves = log.select("place", "leaf")
    length = (leaves.agg(F.max("place")).first()[0] if head else None) or 0
    problems = [(str(size), problem) for size, _, problem in noted_heads(leaves, list(noted)) if problem]
    if head and (head[0] != length + 1 or noted_heads(leaves, [head])[0][2]):
        problems.append((str(head[0]), "head"))
    return registry_verify(log, files).union(log.sparkSession.createDataFrame(problems, "subject string, problem string"))


def rewrites(log: DataFrame) -> DataFrame:
    """path, published: the paths that were published more than once, each time with other content."""
    return registry_latest(log.select("index", "path", "hash")).where("published > 1").select("path", "published")


def new_publications(log: DataFrame, publications: DataFrame) -> DataFrame:
    """``publications``: n (their order), path, hash -> those that a log records: not what it last recorded for the path; with index."""
    last = log.groupBy("path").agg(F.max_by("hash", "index").alias("_last"))
    before = F.lag("hash").over(Window.partitionBy("path").orderBy("n"))
    new = publications.join(last, "path", "left").withColumn("_before", F.coalesce(before, "_last")).where(~F.col("hash").eqNullSafe(F.col("_before"))).drop("_last", "_before")
    start = log.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    # numbered in two steps: places in a block of publications, and what the blocks before it hold
    block = F.floor(F.col("n") / 65_536)
    counts = new.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    ahead = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(block).orderBy("n")) - 1
    return new.withColumn("_own", own).join(F.broadcast(ahead), block == F.col("_block")).withColumn("index", (F.lit(start) + F.col("_ahead") + F.col("_own")).cast("long")).drop("_own", "_ahead", "_block")
