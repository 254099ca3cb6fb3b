"""Conversation prefix tries: double arrays by shard of a lexicographic order, upper nodes merged over shards.

A turn is known by a key: 16 bytes of MD5 of its role and text, and its text's
length.  A conversation's keys in turn make its path; paths, with ties by
conv_id, are dealt out by range, so a shard holds one stretch of the trie and a
beginning that a third of all conversations share is spread over many shards.

In a shard the distinct keys become dense turn ids and its conversations are
packed into a double array (BASE and CHECK: the child of slot s by turn id c is
slot BASE[s] + c, and its CHECK is s).  All conversations then walk through the
arrays together; where they pass and end gives the counts of the nodes, and CHECK
leads sums from nodes to those above them.

Only nodes on the paths at a shard's two ends can lie in other shards too: those
no deeper than what these paths share with their neighbours'.  All other nodes
are final in their shard.  The shared upper nodes' sums add up over shards, as
each shard counts a node's own share only where the node begins (its text's bytes
as a child of its parent) or ends (as a leaf).

A conversation's keys (20 bytes a turn), never its texts, meet in one task; so do
the ids that make up one digest, streamed in chunks, as a SHA-256 is one chain.

Edge cases: null roles and texts are empty; turns are ordered by number, null
first, and those of one number by the MD5 of role and text; rows without a
conv_id take no part; repeated rows are turns of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KEY = 20
#: Turns of a shard, about; ids in one chunk of a list that spans shards; free slots tried for a node's children; shared nodes that are broadcast at most.
SHARD_TURNS, CHUNK_IDS, TRIES, BROADCAST_NODES = 1 << 18, 1 << 14, 64, 100_000
#: Conversations of one family take their beginnings from its first.
FAMILY = 5


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell role and text, 4 bytes that hold the text's length in UTF-8."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(told, F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def turns(conversations: DataFrame) -> DataFrame:
    """``conversations``: conv_id, turn, role, text -> conv_id, keys array<binary> in turn."""
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), turn_key(F.col("role"), F.col("text")).alias("key"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("place"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return lists.select("conv_id", F.transform("places", lambda p: p["key"]).alias("keys"))


def rebuilt(lists: DataFrame, family: int = FAMILY) -> DataFrame:
    """Each conversation c with the first h turns of c - c % family in place of its own first h; h = crc32(c) % 9."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % 9).cast("int")
    lists = materialize(lists, "turn-keys")
    first = lists.where(c % family == 0).select(c.alias("of"), F.slice("keys", 1, 8).alias("base"))
    both = lists.select("conv_id", "keys", h.alias("h"), (c - c % family).alias("first")).join(first, F.col("first") == F.col("of"), "left")
    base = F.slice(F.coalesce("base", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    own = F.slice("keys", F.col("h") + 1, F.greatest(F.size("keys") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(base, own).alias("keys"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with together."""
    n = min(len(a), len(b))
    other = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - -(-other.bit_length() // 8)) // KEY


class DoubleArray:
    """BASE and CHECK over dense turn ids (from 1) of paths in ascending order; slot 0 is the root."""

    def __init__(self, paths: list[bytes]):
        self.ids: dict[bytes, int] = {}
        children: list[list[tuple[int, int]]] = [[]]  # of each node: (turn id, node)
        on: list[int] = [0]  # nodes of the path before
        last = b""
        for path in paths:
            if path == last:
                continue
            del on[shared_turns(last, path) + 1 :]
            for k in range((len(on) - 1) * KEY, len(path), KEY):
                c = self.ids.setdefault(path[k : k + KEY], len(self.ids) + 1)
                children[on[-1]].append((c, len(children)))
                on.append(len(children))
                children.append([])
            last = path
        self.pack(children)

    def pack(self, children: list[list[tuple[int, int]]]) -> None:
        """Give every node its slot, level by level and in a level large families first: each at the first base where all its slots are free."""
        base, check = [0], [-2]
        slot = [0] * len(children)
        level, free = [0], 1  # no slot below is free
        while level:
            below = []
            for node in sorted(level, key=lambda x: -len(children[x])):
                kids = sorted(children[node])
                if not kids:
                    continue
                while free < len(check) and check[free] != -1:
                    free += 1
                low, at = kids[0][0], free
                if len(kids) > 1:
                    for _ in range(TRIES):
                        if all(at + c - low >= len(check) or check[at + c - low] == -1 for c, _ in kids):
                            break
                        at += 1
                        while at < len(check) and check[at] != -1:
                            at += 1
                    else:
                        at = len(check)
                base[slot[node]] = at - low
                if (more := at + kids[-1][0] - low + 1 - len(check)) > 0:
                    base += [0] * more
                    check += [-1] * more
                for c, x in kids:
                    slot[x] = at + c - low
                    check[slot[x]] = slot[node]
                    below.append(x)
            level = below
        self.base, self.check = np.array(base, np.int64), np.array(check, np.int64)

    def step(self, slots: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The children of slots by turn ids; -1 where there are none."""
        to = self.base[slots] + c
        ok = (c > 0) & (to > 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == slots[ok]
        return np.where(ok, to, -1)

    def find(self, path: bytes) -> int:
        """The slot that a path leads to; -1 where there is none."""
        at = 0
        for k in range(0, len(path), KEY):
            at = int(self.step(np.array([at]), np.array([self.ids.get(path[k : k + KEY], 0)]))[0])
            if at < 0:
                break
        return at


NODES = (
    "shard int, slot int, base int, check int, turn_key binary, path_key binary, parent_key binary, shared boolean, parent_shared boolean, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<string>"
)


def path_key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:16]


def _shard_nodes(shard: int, paths: list[bytes], convs: np.ndarray, before: int, after: int) -> dict[str, list]:
    """The nodes of one shard. ``before``, ``after``: turns that its first and last path share with its neighbours (-1: none there)."""
    trie = DoubleArray(paths)
    n = len(trie.check)
    lengths = np.array([len(p) // KEY for p in paths])
    flat = np.array([trie.ids[p[k : k + KEY]] for p in paths for k in range(0, len(p), KEY)] or [0], np.int64)
    starts = np.cumsum(lengths) - lengths
    count, least, depth = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    first_at = np.full(n, -1, np.int64)  # a conversation that passes
    at, going, end = np.zeros(len(paths), np.int64), np.arange(len(paths)), np.zeros(len(paths), np.int64)
    d = 0
    while len(going):
        np.add.at(count, at, 1)
        np.minimum.at(least, at, convs[going])
        depth[at], first_at[at] = d, going
        stay = lengths[going] == d
        end[going[stay]] = at[stay]
        going, at = going[~stay], at[~stay]
        at = trie.step(at, flat[starts[going] + d]) if len(going) else at
        d += 1
    nodes = np.flatnonzero(count)
    parent = np.where(trie.check[nodes] >= 0, trie.check[nodes], 0)
    of_bytes = np.array([int.from_bytes(paths[first_at[s]][depth[s] * KEY - 4 : depth[s] * KEY], "big") if s else 0 for s in nodes.tolist()], np.int64)
    # nodes that lie in the shard before, in the shard after
    in_before, in_after = np.zeros(n, bool), np.zeros(n, bool)
    for flags, shares, path in ((in_before, before, paths[0]), (in_after, after, paths[-1])):
        if shares >= 0:
            s = 0
            flags[0] = True
            for k in range(shares):
                s = trie.step(np.array([s]), np.array([trie.ids[path[k * KEY : (k + 1) * KEY]]]))[0]
                flags[s] = True
    shared = in_before | in_after
    kids = np.zeros(n, np.int64)
    own = nodes[nodes > 0]
    np.add.at(kids, trie.check[own], 1)
    begins = np.zeros(n, np.int64)
    np.add.at(begins, trie.check[own], (~in_before[own]).astype(np.int64))
    leaves = np.zeros(n, np.int64)
    leaves[nodes] = (kids[nodes] == 0) & ~in_after[nodes]
    saved = np.zeros(n, np.int64)
    saved[nodes] = count[nodes] * of_bytes - np.where(in_before[nodes], 0, of_bytes)
    order = np.argsort(-depth[own], kind="stable")
    for level in np.split(own[order], np.flatnonzero(np.diff(depth[own][order])) + 1):
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])
    # the conversations of one path follow each other, in ascending order
    ends = {int(end[k[0]]): convs[k[0] : k[-1] + 1].tolist() for k in np.split(np.arange(len(paths)), np.flatnonzero(np.diff(end)) + 1)}
    none = hashlib.sha256(b"").hexdigest()
    turn_of = {c: k for k, c in trie.ids.items()}
    out: dict[str, list] = {f.split()[0]: [] for f in NODES.split(", ")}
    for s, up in zip(nodes.tolist(), parent.tolist()):
        ids = ends.get(s, ())
        path = paths[first_at[s]][: depth[s] * KEY]
        is_shared, up_shared = bool(shared[s]), bool(s and shared[up])
        keyed = is_shared or up_shared
        row = (
            shard, s, int(trie.base[s]), int(trie.check[s]) if s else None, turn_of[s - int(trie.base[up])] if s else None, path_key(path) if is_shared else None, path_key(path[:-KEY]) if keyed and s else None, is_shared, up_shared,
            int(depth[s]), int(least[s]), int(least[up]) if s else None, int(count[s]), int(begins[s]), int(leaves[s]), int(saved[s]),
            None if is_shared else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else none,
            [",".join(map(str, ids[k : k + CHUNK_IDS])) for k in range(0, len(ids), CHUNK_IDS)] if is_shared else None,
        )
        for column, value in zip(out.values(), row):
            column.append(value)
    return out


def _neighbours(edges: DataFrame) -> DataFrame:
    """``edges``: shard, low, high (its first and last path) -> shard, before, after: turns shared with its neighbours."""

    def run(batches):
        done, last, held = [], None, None  # held: the shard that waits for its neighbour
        for b in batches:
            for r in b.to_pylist():
                shares = shared_turns(last, r["low"]) if last is not None else -1
                if held:
                    done.append((*held, shares))
                held, last = (r["shard"], shares), r["high"]
        if held:
            done.append((*held, -1))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["shard", "before", "after"])

    return edges.coalesce(1).sortWithinPartitions("shard").mapInArrow(run, "shard int, before int, after int")


def _digests(chunks: DataFrame) -> DataFrame:
    """``chunks``: path_key, shard, k, ids -> path_key, ends_sha256; the chunks of a node are streamed in order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column("path_key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["path_key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["path_key", "ends_sha256"])

    return chunks.repartition("path_key").sortWithinPartitions("path_key", "shard", "k").select("path_key", "ids").mapInArrow(run, "path_key binary, ends_sha256 string")


def shards(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``lists``: conv_id, keys -> shard, path, conv_id, dealt out by range of (path, conv_id)."""
    spark = lists.sparkSession
    paths = materialize(lists.select(F.array_join(F.transform("keys", lambda k: F.hex(k)), "").alias("hexed"), "conv_id").select(F.unhex("hexed").alias("path"), "conv_id"), "paths")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(paths.agg(F.sum(F.octet_length("path"))).first()[0] or 0) // (KEY * shard_turns)))
    dealt = paths.repartitionByRange(n, "path", "conv_id")
    return materialize(dealt.select(F.spark_partition_id().alias("shard"), "path", "conv_id"), "shards")


def nodes(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``lists``: conv_id, keys of each conversation -> the nodes of their trie.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and where the node
    lies in the double arrays: shard, slot, base, check, turn_key (of a shared node: in the first of its shards).
    """
    spark = lists.sparkSession
    rows = shards(lists, shard_turns)
    edges = rows.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    sides = {r["shard"]: (r["before"], r["after"]) for r in _neighbours(edges).toLocalIterator()}  # three numbers a shard
    shared_sides = spark.sparkContext.broadcast(sides)

    def run(batches) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        fields = [f.split() for f in NODES.split(", ")]
        shard, paths, convs = None, [], []

        def flush():
            out = _shard_nodes(shard, paths, np.array(convs, np.int64), *shared_sides.value[shard])
            whole = pa.RecordBatch.from_arrays([pa.array(out[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])
            for k in range(0, whole.num_rows, 10_000):
                yield whole.slice(k, 10_000)

        for b in batches:
            for s, path, c in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), b.column("conv_id").to_pylist()):
                if s != shard and paths:
                    yield from flush()
                    paths, convs = [], []
                shard = s
                paths.append(path)
                convs.append(c)
        if paths:
            yield from flush()

    n = max(1, len(sides))
    found = materialize(rows.repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, NODES), "trie-nodes")
    upper = found.where("shared")
    where = F.min_by(F.struct("shard", "slot", "base", "check", "turn_key"), "shard").alias("at")
    sums = upper.groupBy("path_key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), where,
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    chunks = upper.select("path_key", "shard", F.posexplode("ends").alias("k", "ids"))
    sums = sums.join(_digests(chunks).withColumnRenamed("path_key", "of"), F.col("path_key") == F.col("of"), "left").drop("of")
    sums = materialize(sums.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "upper-nodes")
    named = sums.select(F.col("path_key").alias("of"), F.col("conv_id").alias("parent"))
    few = sums.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    named = F.broadcast(named) if few else named
    place = ["shard", "slot", "base", "check", "turn_key"]
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", *place]
    inner = found.where("NOT shared AND NOT parent_shared").select(cols)
    hung = found.where("NOT shared AND parent_shared").join(named, F.col("parent_key") == F.col("of")).withColumn("parent_conv_id", F.col("parent")).select(cols)
    top = sums.join(named, F.col("parent_key") == F.col("of"), "left").withColumn("parent_conv_id", F.col("parent")).select("*", *(F.col(f"at.{c}").alias(c) for c in place)).select(cols)
    return inner.unionByName(hung).unionByName(top)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``conversations``: conv_id, turn, role, text -> the nodes of the trie of the conversations as they are."""
    return nodes(turns(conversations), shard_turns)
