"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the vectors again and again by the median of their projection
on the difference of two random vectors.  The trees are fitted on a bounded
sample (``SAMPLE_ROWS`` vectors, by hash), so the planes have a fixed size and
are broadcast; every vector is then put into its leaf of each tree.

A query walks all trees with one priority queue: entries are subtrees, keyed by
the sum of squared margins that leaving for them has cost, and the cheapest is
opened next, whichever tree it is in, until the leaves opened hold
``OPEN`` times n^``POWER`` of the n vectors there are.  Leaf by leaf its queries meet its vectors (one
task a leaf and chunk), the best of each leaf are rescored exactly, and the best
of all leaves are kept.

The work of a query so grows more slowly than the vectors: leaves that hold 1.35 n
of 2,000 vectors are opened, 0.6 n of 50,000, 0.05 n of 10^9.  ``OPEN`` and
``POWER`` suit vectors without structure, whose neighbours are hardly nearer than
the rest: recall at 5 is above 0.9 there at every size measured. Clustered vectors need far less.

Equal vectors are one class with its smallest ids, which is all a result can
hold of them, so copies cost nothing. Leaves are met in chunks of at most about
``CHUNK_ROWS`` vectors and queries, so no task grows with the input.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows without a vec_id; vectors of another length are no candidates; fewer candidates than
``k`` are all returned; a repeated id is one candidate for each distinct vector it
has; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, SAMPLE_ROWS, LEAF_ROWS, OPEN, POWER, CHUNK_ROWS, SEED = 8, 8192, 32, 9.0, 0.75, 4096, 11


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (with its own kind of numbers) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element(vectors)}>").alias("embedding"))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def element(vectors: DataFrame) -> str:
    """float where the vectors are of that type, else double."""
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def fit_forest(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> list[dict[str, np.ndarray]]:
    """Trees as arrays: planes, thresholds, left and right children (a negative child -k-1 is leaf k)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        planes, cuts, child, leaves = [], [], [], 0
        todo = [(np.arange(len(sample)), -1, 0)]  # rows, parent, side
        while todo:
            rows, parent, side = todo.pop()
            node = None
            if len(rows) > leaf_rows:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                w = a - b
                p = sample[rows] @ w
                cut = np.median(p)
                left = p <= cut
                if 0 < left.sum() < len(rows):
                    node = len(planes)
                    planes.append(w / np.linalg.norm(w))
                    cuts.append(cut / np.linalg.norm(w))
                    child.append([0, 0])
                    todo += [(rows[left], node, 0), (rows[~left], node, 1)]
            if node is None:
                node, leaves = -leaves - 1, leaves + 1
            if parent >= 0:
                child[parent][side] = node
        dim = sample.shape[1]
        out.append({"planes": np.array(planes).reshape(-1, dim), "cuts": np.array(cuts), "child": np.array(child, np.int64).reshape(-1, 2), "leaves": leaves})
    return out


def leaves_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of unit vectors."""
    node = np.zeros(len(x), np.int64) if len(tree["cuts"]) else np.full(len(x), -1)
    while (node >= 0).any():
        live = np.flatnonzero(node >= 0)
        at = node[live]
        right = (x[live] * tree["planes"][at]).sum(1) > tree["cuts"][at]
        node[live] = tree["child"][at, right.astype(np.int64)]
    return -node - 1


def search(forest: list[dict], held: list[np.ndarray], x: np.ndarray, want: float) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves opened for one unit vector until they hold ``want`` vectors."""
    margins = [t["planes"] @ x - t["cuts"] for t in forest]
    queue = [(0.0, t, 0 if len(forest[t]["cuts"]) else -1) for t in range(len(forest))]
    out, n = [], 0
    while queue and n < want:
        cost, t, node = heapq.heappop(queue)
        child, m = forest[t]["child"], margins[t]
        while node >= 0:
            d = float(m[node])
            near, far = child[node] if d <= 0 else child[node][::-1]
            heapq.heappush(queue, (cost + d * d, t, int(far)))
            node = int(near)
        out.append((t, -node - 1))
        n += int(held[t][-node - 1])
    return out


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow, no underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaling by powers of two keeps every digit and stops overflow and underflow."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best_of(close: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Of each row of scores the places of the m best, ties (and scores that rounding alone may part) to smaller ids."""
    m = min(m, close.shape[1])
    worst = -np.partition(-close, m - 1, axis=1)[:, m - 1 : m]
    out = np.empty((len(close), m), np.int64)
    for i, row in enumerate(close >= worst - 1e-12):
        at = np.flatnonzero(row)
        out[i] = at[np.lexsort((ids[at], -np.round(close[i, at], 12)))[:m]]
    return out


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, share: float | None = None) -> DataFrame:
    """``vectors``: vec_id, embedding; ``is_query``: condition on vec_id -> query_id, rank, vec_id, score of the k nearest found.

    Vectors of different lengths have no cosine: each length is searched by itself. With ``share`` leaves are opened until
    they hold ``share`` times the vectors, whatever their number.
    """
    v = materialize(usable(vectors), "ann-vectors")
    lengths = [r["n"] for r in v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    out = [_nearest(v.where(F.size("embedding") == n), element(vectors), is_query, k, trees, sample_rows, share) for n in lengths or [0]]
    return reduce(DataFrame.union, out)


def _nearest(v: DataFrame, kind: str, is_query, k: int, trees: int, sample_rows: int, share: float | None) -> DataFrame:
    """``nearest`` among the vectors of one length."""
    spark = v.sparkSession
    # equal vectors: the class of their smallest id, with the k + 1 smallest (a limit inside the window: few rows of a copy are shuffled)
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = v.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.select(F.col("ids")[0].alias("class"), "ids", "embedding"), "ann-classes")
    asked = materialize(v.where(is_query).alias("q").join(classes.alias("c"), F.col("q.embedding") == F.col("c.embedding")).select(F.col("q.vec_id").alias("query_id"), F.col("c.class").alias("class")).distinct(), "ann-queries")

    sample = classes.orderBy(F.xxhash64(F.lit(SEED), "class"), "class").limit(sample_rows).select("embedding").toArrow()
    n = classes.count()
    forest = fit_forest(_unit(_matrix(sample.column("embedding"))), trees) if n else []
    shared = spark.sparkContext.broadcast(forest)  # bounded by sample_rows and trees

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("embedding")))
                at = np.stack([leaves_of(t, x) for t in shared.value], 1).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("class"), b.column("embedding"), leaves], names=["class", "embedding", "leaves"])

    placed = materialize(classes.select("class", "embedding").mapInArrow(place, f"class long, embedding array<{kind}>, leaves array<int>"), "ann-leaves")
    rows = placed.select("class", "embedding", F.posexplode("leaves").alias("tree", "leaf"))
    held = [np.zeros(t["leaves"], np.int64) for t in forest]
    for r in rows.groupBy("tree", "leaf").count().toLocalIterator():
        held[r["tree"]][r["leaf"]] = r["count"]
    shared_held = spark.sparkContext.broadcast(held)
    want = OPEN * n**POWER if share is None else share * n

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column("embedding")))
            found = [search(shared.value, shared_held.value, q, want) for q in x]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            t, leaf = (np.array([p[i] for f in found for p in f], np.int32) for i in (0, 1))
            out = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([out.column("class"), out.column("embedding"), pa.array(t), pa.array(leaf)], names=["class", "embedding", "tree", "leaf"])

    queries = placed.join(asked.select("class").distinct(), "class", "left_semi").select("class", "embedding")
    n_queries = asked.select("class").distinct().count()
    probes = queries.mapInArrow(probe, f"class long, embedding array<{kind}>, tree int, leaf int")

    # chunks of a leaf: every chunk of its vectors meets every chunk of its queries
    most = max([1, *(int(h.max()) for h in held)])
    n_v, n_q = -(-most // CHUNK_ROWS), -(-n_queries // CHUNK_ROWS)
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("cv", F.pmod(F.xxhash64("class"), F.lit(n_v)).cast("int")).withColumn("cq", numbers(n_q) if n_q > 1 else F.lit(0))
    right = probes.withColumn("cq", F.pmod(F.xxhash64("class"), F.lit(n_q)).cast("int")).withColumn("cv", numbers(n_v) if n_v > 1 else F.lit(0))

    def meet(key, vecs: pa.Table, qs: pa.Table) -> pa.Table:
        names = ["query", "class", "score"]
        if not vecs.num_rows or not qs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        v, q = _matrix(vecs.column("embedding")), _matrix(qs.column("embedding"))
        ids, qids = vecs.column("class").to_numpy(), qs.column("class").to_numpy()
        close = _unit(q) @ _unit(v).T
        top = best_of(close, ids, k + 3)  # a few more than needed: the product's rounding decides nothing
        of, top = np.repeat(np.arange(len(qids)), top.shape[1]), top.ravel()
        return pa.table([pa.array(qids[of]), pa.array(ids[top]), pa.array(cosine(q[of], v[top]))], names=names)

    by = ["tree", "leaf", "cv", "cq"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query long, class long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    found = found.join(classes.select("class", "ids"), "class").select("query", F.explode(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.alias("vec_id")))).alias("hit"))
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    hits = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(lists, F.col("class") == F.col("query")).select("query_id", F.posexplode(hits).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
