"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bit is set where over half of its shingles' XXH64 values (seed
42) have it set.  To find all pairs at ``radius`` or fewer differing bits, the 64
bits are cut into 32 segments and a fingerprint is mapped to the vector of its
segments' bit counts.  The Manhattan distance of two such vectors never exceeds
the number of differing bits, so it is a lower bound.  The vector's coordinates
are dealt into ``radius + equal`` groups: within the radius at most ``radius``
groups differ, so at least ``equal`` groups agree in full.  The grid join
therefore has one cell for each choice of ``equal`` groups and values of their
coordinates; every pair within the radius meets in some cell.  In a cell pairs
are screened by the Manhattan bound and then verified exactly.

Copies are collapsed to one fingerprint first.  A cell gives the edges of a
spanning forest of its true links, never all pairs, so a large group of near
copies costs its size.  Cells of more than ``CHUNK`` fingerprints are cut into
chunks whose pairs are dealt to different tasks.  Components are found by
alternating large-star and small-star rounds of joins, each written to the
shared folder.

Edge cases: null and empty texts have fingerprint zero and link like any other;
with fewer words than a shingle the whole sequence is the one shingle; repeated
rows are rows of their own in the same component; a null doc_id is never a
component's id unless the component has no other (then the id is null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize, plain_names, scratch_scope, words

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a cell that one task compares; larger cells are cut into pairs of chunks.
CHUNK = 1 << 14
#: Runs of at most this many fingerprints are compared by shifting, larger ones by searching from each fingerprint.
SHORT = 32
_EVEN = 0x5555555555555555


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first: counted by the values of their bytes."""
    at = h.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    return (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()


def digests(w: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the runs of ``shingle`` words (of all words, if they are fewer), in arrays of bounded length."""
    data = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1)
    stop = end[shingle - 1 :] if len(w) >= shingle else end[-1:]
    for at in range(0, n, 1 << 16):
        a, b = start[at : min(n, at + (1 << 16))].tolist(), stop[at : at + (1 << 16)].tolist()
        yield np.array([digest(data[i:j], SEED) for i, j in zip(a, b)], np.uint64)


def _majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have."""
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    w = words(text)
    return _majority(sum(bit_counts(h) for h in digests(w, shingle)), max(1, len(w) - shingle + 1)) if w else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs``: doc_id, text -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp):
    """The 32 segments' bit counts, packed as two-bit numbers: of a Column or an int64 array."""
    if isinstance(fp, np.ndarray):
        u, m, one = fp.view(np.uint64), np.uint64(_EVEN), np.uint64(1)
        return ((u & m) + ((u >> one) & m)).view(np.int64)
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cell_masks(radius: int, equal: int) -> list[int]:
    """For every choice of ``equal`` of the groups, the packed coordinates it keeps (as signed longs)."""
    groups = np.array_split(np.arange(32), radius + equal)
    field = [sum(3 << (2 * int(i)) for i in g) for g in groups]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(field, equal)]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed count vectors; fields hold 0, 1 or 2."""
    m = np.uint64(0x3333333333333333)
    hi = np.uint64(0x8888888888888888)
    out = np.zeros(len(a), np.int64)
    for s in (np.uint64(0), np.uint64(2)):
        x, y = (a.view(np.uint64) >> s) & m, (b.view(np.uint64) >> s) & m
        # x + 8 - y in four-bit fields: the difference, 8 added
        d = (x + hi - y).view(np.uint8)
        out += (np.abs((d & 15).astype(np.int8) - 8) + np.abs((d >> 4).astype(np.int8) - 8)).reshape(-1, 8).sum(1)
    return out


def _linked(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs link: the lower bound first, then the bits."""
    ok = np.flatnonzero(manhattan(segment_counts(x), segment_counts(y)) <= radius)
    return ok[np.bitwise_count(x[ok].view(np.uint64) ^ y[ok].view(np.uint64)) <= radius]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (as places) that span the linked groups of one large cell."""
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            for v in todo.pop():
                hit = _linked(np.full(len(rest), fps[v]), fps[rest], radius)
                if len(hit):
                    out.append((np.full(len(hit), v), rest[hit]))
                    todo.append(rest[hit])
                    rest = np.delete(rest, hit)
    return out


def cell_edges(batches, radius: int = RADIUS):
    """Edges of the cells in rows sorted by (cell, part); the last, open run is carried to the next batch."""
    key_tail, tail = np.empty((0, 2), np.int64), np.empty(0, np.int64)

    def edges(keys, fps):
        out = []
        new = np.ones(len(fps), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fps)))
        run = np.repeat(np.arange(len(start)), size)
        for d in range(1, min(SHORT, int(size.max(initial=0)))):
            i = np.flatnonzero((run[d:] == run[:-d]) & (size[run[:-d]] <= SHORT))
            if not len(i):
                break
            hit = i[_linked(fps[i], fps[i + d], radius)]
            if len(hit):
                out.append((hit, hit + d))
        for k in np.flatnonzero(size > SHORT):
            out += [(a + start[k], b + start[k]) for a, b in _forest(fps[start[k] : start[k] + size[k]], radius)]
        if out:
            a, b = (fps[np.concatenate(x)] for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def columns(b, names):
        return np.stack([b.column(c).to_numpy().astype(np.int64) for c in names], 1)

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.concatenate((key_tail, columns(b, ("cell", "part"))))
        rows = np.concatenate((tail, b.column("fp").to_numpy()))
        last = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0
        key_tail, tail = keys[cut:], rows[cut:]
        if cut:
            yield from edges(keys[:cut], rows[:cut])
    if len(tail):
        yield from edges(key_tail, tail)


#: Groups that agree in a cell, at least; what a row of a shared cell, and a fingerprint that it meets there, cost beside a row that is alone.
LEAST_EQUAL, SHARED_COST, MET_COST = 4, 6.0, 0.02


def width(n: int, radius: int = RADIUS) -> int:
    """The ``equal`` to choose for a corpus of ``n`` fingerprints: it makes a fingerprint's cells and those it meets in them cost least.

    A segment of two random bits has 1.5 bits of entropy in its count, in texts about 0.94 of that. A row of a shared cell is joined,
    shuffled and sorted, whomever it meets, and compared with each, which is cheap; any cell may be shared, if only by copies. So a
    fingerprint has 70 cells up to some 10^9 fingerprints and 210 at 5 x 10^10.
    """

    def cost(equal: int) -> float:
        met = n * 2 ** (-45 * equal / (radius + equal))
        return comb(radius + equal, equal) * (1 + SHARED_COST + MET_COST * met)

    return min(range(LEAST_EQUAL, 33 - radius), key=cost)


def by_shuffle(table: DataFrame) -> DataFrame:
    """``table``, which joins by a shuffle whatever its size: what grows with the corpus is never held by the driver."""
    return table.hint("merge")


def shared_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells``: node and the columns ``by`` -> those with more than one node, with n and hub (the smallest node).

    Cells are counted before rows meet: a hot cell is one row by then. Rows and counts meet by a join that adaptive
    execution splits where a cell is hot; the counts are not broadcast, as they grow with the corpus and the driver would hold them.
    """
    many = materialize(cells.groupBy(*by).agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "cell-counts")
    return materialize(cells.join(by_shuffle(many), by), "cells")


def links(nodes: DataFrame, radius: int = RADIUS, equal: int = 3, chunk: int = CHUNK) -> DataFrame:
    """``nodes``: fp (each once) -> edges (src, dst) between fingerprints that connect exactly what links of the radius connect.

    ``equal`` (see ``width``) changes the work, never the result. A cell is known by a hash of its groups and values,
    so its row is two numbers; if two cells shared a hash, their fingerprints would only be compared as well.
    """
    counts = segment_counts(F.col("fp"))
    masks = F.array(*map(F.lit, cell_masks(radius, equal)))
    cells = nodes.select(F.col("fp").alias("node"), F.explode(F.transform(masks, lambda m: F.xxhash64(m, counts.bitwiseAND(m)))).alias("cell"))
    cells = shared_cells(cells, ["cell"]).withColumnRenamed("node", "fp")
    # part: a pair of chunks (i <= j), written i * k + j; one part where the cell is no larger than a chunk
    k = F.ceil(F.col("n") / F.lit(float(chunk)))
    own = F.pmod(F.xxhash64("fp"), k)
    parts = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.least(own, j) * k + F.greatest(own, j)))
    small = cells.where(F.col("n") <= chunk).withColumn("part", F.lit(0).cast("long"))
    rows = small.unionByName(cells.where(F.col("n") > chunk).withColumn("part", parts)).drop("n", "hub")
    rows = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "fp")
    return rows.mapInArrow(lambda b: cell_edges(b, radius), "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) -> node, root (the smallest node it reaches), for the nodes that have edges.

    Large-star joins a node's larger neighbours to its smallest neighbour, small-star
    the smaller ones; both keep the components. When neither changes the edges they
    are stars round the roots. Each step is written, so joins meet by shuffles of plain rows: a hub's are split where they
    are many, and the driver holds no table.
    """
    e = materialize(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
        large = materialize(both.join(by_shuffle(m), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "edges-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
        small = large.join(by_shuffle(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e, last = materialize(small, "edges"), e
        for done in (m, large, low, last):
            discard(done)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def dedupe(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs``: doc_id, text -> doc_id, fp, component_id (smallest doc_id reachable), one row a document."""
    with scratch_scope():
        fps = materialize(fingerprints(docs, shingle), "fingerprints", stays=True)
        nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fp-nodes")
        roots = components(links(nodes.select("fp"), radius, width(nodes.count(), radius)))
        named = materialize(nodes.join(by_shuffle(roots), nodes["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "nodes")
        smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        by_fp = materialize(named.join(by_shuffle(smallest), "root").select("fp", "component_id"), "fp-components", stays=True)
    return fps.join(by_shuffle(by_fp), "fp").select("doc_id", "fp", "component_id")


#: Documents of the corpus are near-duplicates at a Jaccard similarity of ``SIMILAR`` of their sets of ``NEAR_SHINGLE``-word shingles.
SIMILAR, NEAR_SHINGLE = 0.8, 5
#: Candidates of them: nodes whose ``BAND_ROWS`` smallest hashes agree under one of ``BANDS`` groups of seeds. A pair of similarity J is
#: missed with probability (1 - J^BAND_ROWS)^BANDS, whatever the edit and the length: 3.2e-6 at 0.8, 6e-12 at 0.9.
BAND_ROWS, BANDS = 4, 24
#: Shingles of a large cell that one task compares with as many others.
NEAR_CHUNK = 1 << 19


def _shingle_hashes(w: list[bytes], shingle: int) -> np.ndarray:
    return np.concatenate(list(digests(w, shingle))) if w else np.empty(0, np.uint64)


def _remix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bands(sets: list[np.ndarray], rows: int = BAND_ROWS, n: int = BANDS) -> np.ndarray:
    """For each of the non-empty shingle lists one value a band, made of the smallest hashes under the band's seeds."""
    out = np.zeros((len(sets), n), np.uint64)
    size = np.array([len(h) for h in sets])
    ends = np.cumsum(size)
    at = 0
    while at < len(sets):  # bounded memory for long texts
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + (1 << 17), "right")))
        flat = np.concatenate(sets[at:to])
        start = ends[at:to] - size[at:to] - (ends[at] - size[at])
        for k in range(n * rows):
            least = np.minimum.reduceat(_remix(flat, k), start)
            out[at:to, k // rows] = _remix(out[at:to, k // rows] ^ least, k % rows)
        at = to
    return out.view(np.int64)


def word_hash(text: Column) -> Column:
    """A hash of the text's words: of words(text) with a blank between."""
    return F.xxhash64(lower_ascii(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))))


def near_bands(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """``docs``: doc_id, text -> doc_id, same (hash of the words), fp (SimHash of the shingles), bands array<long> (empty where there is no word)."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                sets = [_shingle_hashes(words(t.as_py()), shingle) for t in b.column("text")]
                full = [h for h in sets if len(h)]
                flat = bands(full).ravel() if full else np.empty(0, np.int64)
                fp = np.array([_majority(bit_counts(h), len(h)) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0] + [BANDS * bool(len(h)) for h in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(fp), lists], names=["doc_id", "same", "fp", "bands"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hash(F.col("text")).alias("same"), "text")
    return d.mapInArrow(run, "doc_id long, same long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """``docs``: key, text -> key, shingles array<long> (distinct hashes)."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                sets = [np.unique(_shingle_hashes(words(t.as_py()), shingle)).view(np.int64) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select("key", "text").mapInArrow(run, "key long, shingles array<long>")


def open_cells(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the cells of more than two nodes (of two, the one pair is decided) those whose nodes are not yet one component: node, band, value, n, root."""
    known = cells.where("n > 2").select("node", "band", "value", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known, "near-known")
    apart = known.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "value")
    return materialize(known.join(apart, ["band", "value"]), "near-open")


def verified_forest(root: np.ndarray, flat: np.ndarray, size: np.ndarray, similar: float) -> list[tuple[int, np.ndarray]]:
    """Links (as a place and places) that join all roots which a pair of similar sets joins. ``flat``: the sets, one after the other."""
    _, label, members = np.unique(root, return_inverse=True, return_counts=True)
    order = np.argsort(members[label], kind="stable")  # small components first: of the largest no two nodes are compared
    label, sizes = label[order], size[order]
    start = (np.cumsum(size) - size)[order]
    _, ids = np.unique(flat, return_inverse=True)
    ids = np.concatenate([ids[i : i + n] for i, n in zip(start, sizes)])
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    out = []
    for v in range(len(order) - 1):
        if (label[v + 1 :] == label[v]).all():
            continue
        own = ids[start[v] : start[v] + sizes[v]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[start[v + 1] :]], start[v + 1 :] - start[v + 1], dtype=np.int64)
        mark[own] = False
        hit = v + 1 + np.flatnonzero((both / (sizes[v] + sizes[v + 1 :] - both) >= similar) & (label[v + 1 :] != label[v]))
        if len(hit):
            out.append((int(order[v]), order[hit]))
            label[np.isin(label, label[hit])] = label[v]
    return out


def near_forest(cells: DataFrame, sets: DataFrame, similar: float, chunk: int = NEAR_CHUNK) -> DataFrame:
    """``cells``: node, band, value, root -> links (src, dst) of similar nodes that connect all such links between roots do.

    Cells of more than ``chunk`` shingles are cut into chunks whose pairs are dealt to different tasks.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        lists = table.column("shingles").combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        pairs = [(node[v], w) for v, hit in verified_forest(root, flat, size, similar) for w in node[hit]]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"src": np.minimum(a, b), "dst": np.maximum(a, b)})

    c = cells.select("node", "root", "band", "value").join(sets.select(F.col("key").alias("node"), F.size("shingles").alias("n")), "node")
    c = c.drop("n").join(c.groupBy("band", "value").agg(F.sum("n").alias("n")), ["band", "value"])
    k = F.ceil(F.col("n") / F.lit(float(chunk))).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("k"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least(own, j) * F.col("k") + F.greatest(own, j))
    c = c.withColumn("k", k).select("node", "root", "band", "value", F.explode(parts).alias("part"))
    c = c.join(sets.withColumnRenamed("key", "node"), "node")
    return c.groupBy("band", "value", "part").applyInArrow(run, "src long, dst long").distinct()


def pairs_apart(cells: DataFrame) -> DataFrame:
    """``cells``: node, band, value, root, of few nodes each -> the pairs (src, dst) of a cell in two components."""
    a, b = (cells.select("band", "value", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("src", "dst"))
    return a.join(b, ["band", "value"]).where("src < dst AND root_src <> root_dst").select("src", "dst").distinct()


def alike(edges: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The edges (src, dst) whose shingle sets are at least so similar."""
    a, b = sets.select(F.col("key").alias("src"), F.col("shingles").alias("a")), sets.select(F.col("key").alias("dst"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return edges.join(a, "src").join(b, "dst").where(both / (F.size("a") + F.size("b") - both) >= similar).select("src", "dst")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes``: node, fp -> candidates (src, dst): nodes of one fingerprint meet its smallest node, those of linked fingerprints each other's."""
    fps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "near-fps")
    linked = links(fps.select("fp"), radius, width(fps.count(), radius))
    a, b = (fps.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}")) for x in ("src", "dst"))
    between = linked.join(by_shuffle(a), "src").join(by_shuffle(b), "dst").select(F.col("hub_src").alias("src"), F.col("hub_dst").alias("dst"))
    own = nodes.join(by_shuffle(fps), "fp").where("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    return between.union(own)


def near_roots(docs: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """``docs``: doc_id, text -> same (hash of the words), first_doc (smallest doc_id of these words), root of the component.

    Texts of the same words are one node, whatever their ids. Candidates are the links of SimHash fingerprints within the
    radius, found by the cells of segment counts as ``dedupe`` finds them, and, as fingerprints of similar texts may be
    further apart than any radius finds, nodes that share a band's value. Their shingle sets decide. Links to a cell's hub
    are decided first; only what they leave apart is searched in full.
    """
    nodes = near_bands(docs).groupBy("same").agg(F.min("doc_id").alias("first_doc"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "near-nodes")
    with scratch_scope():  # its cells go before those of the bands are made; a node without words has no links
        alike_prints = materialize(fingerprint_links(nodes.where("size(bands) > 0").select(F.col("same").alias("node"), "fp"), radius), "near-prints", stays=True)
    cells = shared_cells(nodes.select(F.col("same").alias("node"), F.posexplode("bands").alias("band", "value")), ["band", "value"])
    hubs = cells.where("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    edges = materialize(hubs.union(alike_prints.select(F.least("src", "dst"), F.greatest("src", "dst"))).distinct(), "near-candidates")
    ends = cells.select(F.col("node").alias("same")).union(alike_prints.select("src")).union(alike_prints.select("dst"))
    # the texts of each candidate node under its smallest id: they have the same words, so any of them gives its shingles
    chosen = nodes.join(ends.distinct(), "same", "left_semi").select(F.col("same").alias("key"), F.col("first_doc").alias("of_doc"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_hash(F.col("text")).alias("same"))
    texts = hashed.join(chosen, (F.col("same") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("key", "text")
    sets = materialize(shingle_sets(texts).groupBy("key").agg(F.first("shingles").alias("shingles")), "near-shingles")
    discard(alike_prints)
    good = materialize(alike(edges, sets, similar), "near-links")
    roots = components(good)
    left = open_cells(cells, roots)
    if not left.isEmpty():
        few = alike(pairs_apart(left.where(F.col("n") <= SHORT)), sets, similar)
        many = near_forest(left.where(F.col("n") > SHORT), sets, similar)
        roots = components(good.union(materialize(few.union(many).distinct(), "near-more")))
    return nodes.drop("bands", "fp").join(roots, F.col("same") == F.col("node"), "left").select("same", "first_doc", F.coalesce("root", "same").alias("root"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each component of near-duplicates, that of smallest id (null last), all columns kept.

    Rows that repeat an id or have none are documents of their own: only their texts decide. Columns may have any names.
    """
    d, at = plain_names(docs)
    first = F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "same")
    with scratch_scope():
        roots = near_roots(d.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), similar)
        kept = materialize(roots.groupBy("root").agg(F.min(first).alias("k")).select("k.same", "k.first_doc"), "near-kept", stays=True)
    rows = d.withColumn("_same", word_hash(F.col(at["text"])))
    rows = rows.join(kept, (F.col("_same") == F.col("same")) & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("first_doc")), "left_semi")
    # of rows with one id and the same words, one; maps can't be hashed
    order = [f.name for f in d.schema if not re.search("map<|variant", f.dataType.simpleString())]
    one = Window.partitionBy("_same").orderBy(F.xxhash64(at["text"]), F.xxhash64(*order))
    return rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth", "_same").toDF(*docs.columns)
