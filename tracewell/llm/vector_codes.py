"""Vector code compression: product codes whose entries are found through tries of the distinct parts.

Vectors become integers (floor of ``SCALE`` times each component) and are cut
into ``PARTS`` equal consecutive parts.  Each part position has a codebook of at
most ``ENTRIES`` entries, taken at first from the smallest ids and moved
``ROUNDS`` times to the floor of the mean of the parts assigned to them.

Training works on the distinct parts with their counts, so copies of a vector,
however many, are one leaf; they are dealt out in lexicographic order, so a task
holds one stretch of each trie.  ``walk`` goes depth-first through the trie of
sorted parts: a node's squared distances to all entries, over the dimensions
above it, are computed once and shared by all that begin with its prefix; edges
without branches are one step.  Leaves take the nearest entry and add their
weighted components to its sums, and only these sums leave a task.  The codes
themselves are found the same way in each batch of whole vectors, with no join.

The codebooks (parts x entries rows) are all that reaches the driver or is broadcast.

Edge cases: vectors that are null or hold null or non-finite components are
dropped; vectors of each length have codebooks of their own; a length that the
parts do not divide is filled up with zeros; null ids count as the largest; rows
that repeat an id are coded one by one, in order of their components; fewer
vectors than entries make smaller codebooks; components beyond 2^86 count as
that; an error beyond a long counts as the largest long; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components up to this are computed with as 64-bit integers, larger ones exactly as Python's.
SMALL, LARGEST, MOST_LONG = 1 << 24, 1 << 86, (1 << 63) - 1
#: Leaves whose distances are held at once; labels whose sums are broadcast at most.
BLOCK_LEAVES, BROADCAST_LABELS = 1024, 100_000


def walk(parts: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trie of the rows of ``parts`` (distinct, in lexicographic order), depth-first.

    Yields (leaves, nearest entry, squared distance) in blocks; ties go to the smaller entry.
    """
    n, dims = parts.shape
    columns = [np.ascontiguousarray(entries[:, d]) for d in range(dims)]
    todo = [(0, n, 0, np.zeros(len(entries), parts.dtype))]  # rows from, to, depth, distances over the dimensions above
    while todo:
        lo, hi, depth, above = todo.pop()
        # a prefix that all rows share is one edge
        while depth < dims and parts[lo, depth] == parts[hi - 1, depth]:
            step = parts[lo, depth] - columns[depth]
            above = above + step * step
            depth += 1
        if depth == dims:
            at = above.argmin()
            yield np.arange(lo, hi), np.full(hi - lo, at), np.full(hi - lo, above[at])
            continue
        cut = np.flatnonzero(parts[lo + 1 : hi, depth] != parts[lo : hi - 1, depth]) + lo + 1
        first, last = np.concatenate(([lo], cut)), np.concatenate((cut, [hi]))
        alone = first[last - first == 1]
        for k in range(0, len(alone), BLOCK_LEAVES):
            leaves = alone[k : k + BLOCK_LEAVES]
            far = np.broadcast_to(above, (len(leaves), len(above))).copy()
            for d in range(depth, dims):
                step = parts[leaves, d, None] - columns[d]
                far += step * step
            at = far.argmin(1)
            yield leaves, at, far[np.arange(len(leaves)), at]
        for a, b in zip(first[last - first > 1][::-1], last[last - first > 1][::-1]):
            step = parts[a, depth] - columns[depth]
            todo.append((int(a), int(b), depth + 1, above + step * step))


def integers(x: np.ndarray) -> np.ndarray:
    """``x`` as Python's integers."""
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``parts`` (distinct, sorted) its nearest entry and squared distance, exactly."""
    if max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) <= SMALL:
        parts, entries = parts.astype(np.int64), entries.astype(np.int64)
    else:
        parts, entries = integers(parts), integers(entries)
    at, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    if parts.shape[1]:
        for rows, a, d in walk(parts, entries):
            at[rows], far[rows] = a, d
    return at, far


def sorted_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``a`` in lexicographic order, and the place there of each row of ``a``."""
    if not a.shape[1]:
        return a[:1], np.zeros(len(a), np.int64)
    order = np.lexsort(a.T[::-1])
    s = a[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]).any(1)))
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integer components (as doubles, which hold them exactly) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floors = F.transform("embedding", lambda x: F.greatest(F.least(_floor(x.cast("double") * scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", floors.alias("x"))


def _floor(x: Column) -> Column:
    """The floor of a double as a double: beyond 2^52 a double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def start(v: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, at most ``entries``."""
    rows = v.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    return integers(np.array(rows.column("x").to_pylist(), float))


def moved(parts: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks after one round: ``parts`` (pos, part, n) are assigned, then each entry is the floor of its parts' mean."""
    shared = parts.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            pos, weight, x = b.column("pos").to_numpy(), b.column("n").to_pylist(), matrix(b.column("part"), width)
            for p in np.unique(pos).tolist():
                rows = np.flatnonzero(pos == p)
                own, back = sorted_rows(x[rows])
                at, _ = nearest(own, shared.value[p])
                w = np.zeros(len(own), object)
                np.add.at(w, back, [weight[r] for r in rows])
                for e in np.unique(at).tolist():
                    of = at == e
                    s = sums.setdefault((p, e), [0, [0] * width])
                    s[0] += sum(w[of])
                    if np.abs(own[of]).max(initial=0) * float(sum(w[of])) < 2.0**62:
                        add = (own[of].astype(np.int64) * w[of].astype(np.int64)[:, None]).sum(0).tolist()
                    else:
                        add = [sum(int(c) * n for c, n in zip(col, w[of])) for col in own[of].T]
                    s[1] = [a + b for a, b in zip(s[1], add)]
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()),
                 pa.array([[Decimal(c) for c in sums[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0)))], names=["pos", "entry", "n", "sums"])

    got = parts.mapInArrow(run, "pos int, entry int, n long, sums array<decimal(38,0)>").groupBy("pos", "entry")
    rows = got.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)] or [F.lit(0)]).alias("sums")).collect()  # parts x entries rows at most
    out = [b.copy() for b in books]
    for r in rows:
        out[r["pos"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"][:width]]
    return out


def _encode(v: DataFrame, length: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Vectors of one length -> (vec_id, label, code, error), codebooks."""
    width = -(-length // parts)
    v = v.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), width * parts - length))) if width * parts != length else v
    first = start(v, entries)
    books = [np.ascontiguousarray(first[:, p * width : (p + 1) * width]) for p in range(parts)]
    cut = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("x", p * width + 1, width).alias("part")) for p in range(parts)])
    distinct = v.select(F.explode(cut).alias("c")).groupBy("c.pos", "c.part").agg(F.count("*").alias("n"))
    distinct = materialize(distinct.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "vector-parts")
    for _ in range(rounds):
        books = moved(distinct, books, width)
    shared = v.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), width * parts)
                codes, error = [], np.zeros(len(x), object)
                for p, book in enumerate(shared.value):
                    own, back = sorted_rows(x[:, p * width : (p + 1) * width])
                    at, far = nearest(own, book)
                    codes.append(at[back])
                    error = error + far[back].astype(object)
                hexed = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, 1).tolist()]
                error = [min(int(e), MOST_LONG) for e in error]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(hexed, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = v.schema["label"].dataType.simpleString()
    return v.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for row in b for c in row).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """``vectors``: vec_id, embedding, label -> (vec_id, label, code, error, codebooks_sha256), codebooks by length of vector."""
    v = materialize(whole(vectors, scale), "vectors")
    lengths = [r["n"] for r in v.groupBy(F.size("x").alias("n")).count().orderBy("n").collect()]
    books, out = {}, []
    for n in lengths:
        codes, books[n] = _encode(v.where(F.size("x") == n), n, parts, entries, rounds)
        out.append(codes.withColumn("codebooks_sha256", F.lit(digest(books[n]))))
    empty = v.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    return materialize(reduce(DataFrame.union, out) if out else empty, "vector-codes"), books


def decompress(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The integer vectors that codes of one length stand for: vec_id, x array<double>."""
    shared = codes.sparkSession.sparkContext.broadcast([np.array(b, float) for b in books])

    def run(batches):
        for b in batches:
            at = np.array([list(bytes.fromhex(c)) for c in b.column("code").to_pylist()], np.int64).reshape(b.num_rows, -1)
            x = [np.concatenate([book[e] for book, e in zip(shared.value, row)]) for row in at]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(x, pa.list_(pa.float64()))], names=["vec_id", "x"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, x array<double>")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: errors summed over equal labels, nulls together."""
    most = F.lit(MOST_LONG).cast("decimal(38,0)")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    sums = materialize(sums, "label-errors")
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
