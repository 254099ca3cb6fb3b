"""LM scoring with a log-frequency Bloom filter.

A bigram model whose counts are kept in a Bloom filter: a bigram seen c times is
entered at the levels 1 .. floor(log2 c) + 1, and its count is read back by
probing level after level until one is missing; level q stands for 2^(q - 1)
occurrences.  The filter has ``BITS_PER_ENTRY`` bits for each entry at every size,
so the rate of false levels (2.4 % with 4 probes) does not depend on the corpus.
It is broadcast up to ``BROADCAST_BYTES``; see below for larger ones.  Probabilities interpolate the bigram with the
add-one unigram, P(w | v) = g * min(c~(vw), c(v), c(w)) / c(v) + (1 - g) * P(w),
where 1 - g is the Good-Turing estimate of unseen bigrams (share of bigrams seen
once).  A word never seen cannot be in a bigram, so false levels need both words known.

Counting: tasks turn texts into 64-bit token and bigram hashes, count them in
runs of ``FLUSH`` tokens and hand on packed arrays, cut into blocks by the
hash's leading bits; a block is merged by one task. A frequent word is one entry
of each run, so no key is hot. Unigram counts stay exact (a hash collision aside:
about V^2 / 2^65). While the vocabulary has at most ``VOCABULARY_LIMIT`` entries and
the filter at most ``BROADCAST_BYTES``, both are broadcast. Beyond that they stay in
the table of blocks: the distinct token and bigram hashes of a chunk of documents
are shuffled to their blocks, meet vocabulary and filter there (each block is sent
once) and bring the counts back. Both ways give the same scores.

Edge cases: null and empty texts are the end token alone; repeated rows train
and are scored one by one; without training rows every count is 0 and
N = V = 0, so each token has probability 1; a null doc_id trains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

BITS_PER_ENTRY, PROBES, LEVELS = 8, 4, 40
FLUSH, VOCABULARY_LIMIT, BROADCAST_BYTES, CHUNK_TOKENS = 1 << 21, 8_000_000, 1 << 26, 1 << 18
#: Blocks for each partition of the input.
BLOCKS_EACH = 16
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and the end token."""
    w = words(text)
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out[-1] = END
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bigrams(t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, history) of each token with the one before it; ``starts``: where documents begin."""
    history = np.empty_like(t)
    history[1:] = t[:-1]
    history[starts] = START
    return mix(history * np.uint64(3) + mix(t)), history


def levels(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS)  # floor(log2 c) + 1


def positions(h: np.ndarray, level: int, probe: int, size) -> np.ndarray:
    salt = np.uint64((level * PROBES + probe + 1) * int(START) % (1 << 64))
    return (mix(h ^ salt) % size).astype(np.int64)


class Filter:
    """The bit blocks of all leading bits, one after the other."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """``sizes``: bits of each block (a power of two of them); ``bits``: all blocks' bytes."""
        self.shift = np.uint64(64 - (len(sizes).bit_length() - 1))
        self.size, self.bits = sizes.astype(np.uint64), bits
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """2^(level - 1) of the highest level entered, 0 if none."""
        out = np.zeros(len(h), np.float64)
        block = (h >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(h), np.int64)
        live = np.flatnonzero(self.size[block] > 0)
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                if not len(live):
                    return out
                at = positions(h[live], level, probe, self.size[block[live]]) + self.start[block[live]]
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[live] = 2.0 ** (level - 1)
        return out


def filter_block(h: np.ndarray, count: np.ndarray) -> bytes:
    """The bits of one block."""
    level = levels(count)
    size = -(-BITS_PER_ENTRY * int(level.sum()) // 64) * 64
    on = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        sel = h[level >= q]
        for probe in range(PROBES):
            on[positions(sel, q, probe, np.uint64(size))] = True
    return np.packbits(on, bitorder="little").tobytes()


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their sums."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


PARTS = "block int, uh binary, un binary, bh binary, bn binary"
BLOCKS = "block int, n_unigrams long, n_tokens long, n_bigrams long, n_single long, uh binary, un binary, bits binary"


def count_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """``docs``: text -> one row a block: exact unigram counts and the bits of its bigrams. ``blocks`` is a power of two."""
    shift = np.uint64(64 - (blocks.bit_length() - 1))

    def cut(h):
        return np.searchsorted(h >> shift, np.arange(blocks + 1, dtype=np.uint64)) if blocks > 1 else np.array([0, len(h)])

    def flush(parts):
        t = np.concatenate(parts)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        uh, un = np.unique(t, return_counts=True)
        bh, bn = np.unique(bigrams(t, starts)[0], return_counts=True)
        u, b = cut(uh), cut(bh)
        rows = [(k, uh[u[k] : u[k + 1]].tobytes(), un[u[k] : u[k + 1]].astype(np.uint32).tobytes(), bh[b[k] : b[k + 1]].tobytes(), bn[b[k] : b[k + 1]].astype(np.uint32).tobytes()) for k in range(blocks) if u[k] < u[k + 1] or b[k] < b[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "uh", "un", "bh", "bn"])

    def run(batches):
        parts, n = [], 0
        for b in batches:
            for text in b.column("text"):
                parts.append(tokens(text.as_py()))
                n += len(parts[-1])
                if n >= FLUSH:
                    yield flush(parts)
                    parts, n = [], 0
        if parts:
            yield flush(parts)

    def merge(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        uh, un = _summed(get("uh", np.uint64), get("un", np.uint32).astype(np.int64))
        bh, bn = _summed(get("bh", np.uint64), get("bn", np.uint32).astype(np.int64))
        row = (table.column("block")[0].as_py(), len(uh), int(un.sum()), int(bn.sum()), int((bn == 1).sum()), uh.tobytes(), un.tobytes(), filter_block(bh, bn))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return docs.select("text").mapInArrow(run, PARTS).groupBy("block").applyInArrow(merge, BLOCKS)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """Totals of the training tokens: N, V, documents, and the weight of the bigrams."""

    def __init__(self, n: int, v: int, n_docs: int, gain: float):
        self.n, self.v, self.n_docs, self.gain = n, v, n_docs, gain

    def score(self, t: np.ndarray, sizes: np.ndarray, word_counts, bigram_counts) -> list[np.ndarray]:
        """n_known, base_score and score of the documents whose tokens ``t`` holds in turn.

        ``word_counts`` and ``bigram_counts`` give the counts of sorted distinct hashes.
        """
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        distinct, place = np.unique(t, return_inverse=True)
        c = word_counts(distinct)[place].astype(np.float64)
        unigram = (c + 1) / (self.n + 1 * (self.v + 1))
        h, place = np.unique(bigrams(t, starts)[0], return_inverse=True)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[starts] = self.n_docs
        both = np.flatnonzero((c > 0) & (before > 0))
        p = unigram.copy()
        p[before > 0] *= 1 - self.gain
        seen = np.minimum(bigram_counts(h)[place[both]], np.minimum(c[both], before[both]))
        p[both] += self.gain * seen / before[both]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        of = lambda x: np.bincount(doc, x, len(sizes))
        return [of(c > 0).astype(np.int64), of(np.log10(unigram)), of(np.log10(p))]


def look_up(h: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of hashes in a sorted vocabulary, 0 where they are not in it."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, counts[at], 0)


def _chunks(batches):
    """Documents in runs of about CHUNK_TOKENS tokens: (doc_ids, held_out, sizes, tokens)."""
    ids, held, parts, n = [], [], [], 0
    for b in batches:
        for doc_id, h, text in zip(b.column("doc_id"), b.column("held_out"), b.column("text")):
            ids.append(doc_id.as_py())
            held.append(h.as_py())
            parts.append(tokens(text.as_py()))
            n += len(parts[-1])
            if n >= CHUNK_TOKENS:
                yield ids, held, np.array([len(p) for p in parts]), np.concatenate(parts)
                ids, held, parts, n = [], [], [], 0
    if ids:
        yield ids, held, np.array([len(p) for p in parts]), np.concatenate(parts)


def _scored(model: Model, ids, held, sizes, t, word_counts, bigram_counts) -> pa.RecordBatch:
    known, base, score = model.score(t, sizes, word_counts, bigram_counts)
    cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(len(ids), model.n), pa.int64()), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])


def _by_broadcast(docs: DataFrame, totals: dict, vocabulary, bits) -> DataFrame:
    def run(batches):
        m, (vh, vn), f = Model(**totals), vocabulary.value, Filter(*bits.value)
        for chunk in _chunks(batches):
            yield _scored(m, *chunk, lambda h: look_up(h, vh, vn), f.count)

    return docs.mapInArrow(run, SCORED)


CHUNKS = "chunk string, ids array<long>, held array<boolean>, sizes array<long>, t binary, wanted array<struct<block:int,words:binary,bigrams:binary>>"


def _by_shuffle(docs: DataFrame, totals: dict, counted: DataFrame, blocks: int) -> DataFrame:
    """Chunks keep their tokens in a table; their distinct hashes go to the blocks and come back with counts."""
    shift = np.uint64(64 - (blocks.bit_length() - 1))

    def cut(batches):
        import uuid

        edges = lambda h: np.searchsorted(h >> shift, np.arange(blocks + 1, dtype=np.uint64)) if blocks > 1 else np.array([0, len(h)])
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("block", pa.int32()), ("words", pa.binary()), ("bigrams", pa.binary())])))
        for ids, held, sizes, t in _chunks(batches):
            w, g = np.unique(t), np.unique(bigrams(t, np.concatenate(([0], np.cumsum(sizes)[:-1])))[0])
            a, b = edges(w), edges(g)
            wanted = [{"block": k, "words": w[a[k] : a[k + 1]].tobytes(), "bigrams": g[b[k] : b[k + 1]].tobytes()} for k in range(blocks) if a[k] < a[k + 1] or b[k] < b[k + 1]]
            row = (uuid.uuid4().hex, ids, held, sizes.tolist(), t.tobytes(), wanted)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["chunk", "ids", "held", "sizes", "t", "wanted"])

    chunks = materialize(docs.mapInArrow(cut, CHUNKS), "lm-chunks", wide=True)

    def meet(wanted: pa.Table, block: pa.Table) -> pa.Table:
        known = block.to_pylist()[0] if block.num_rows else {"uh": b"", "un": b"", "bits": b""}
        vh, vn = np.frombuffer(known["uh"], np.uint64), np.frombuffer(known["un"], np.int64)
        bits = np.frombuffer(known["bits"], np.uint8)
        f = Filter(np.array([8 * len(bits)]), bits)
        get = lambda c: (np.frombuffer(x.as_py(), np.uint64) for x in wanted.column(c))
        n_words = [look_up(h, vh, vn).astype(np.int64).tobytes() for h in get("words")]
        n_bigrams = [f.count(h).tobytes() for h in get("bigrams")]
        return pa.table({"chunk": wanted.column("chunk"), "block": wanted.column("block"), "n_words": pa.array(n_words, pa.binary()), "n_bigrams": pa.array(n_bigrams, pa.binary())})

    wanted = chunks.select("chunk", F.inline("wanted")).groupBy("block").cogroup(counted.select("block", "uh", "un", "bits").groupBy("block"))
    found = wanted.applyInArrow(meet, "chunk string, block int, n_words binary, n_bigrams binary")
    found = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("block", "n_words", "n_bigrams"))).alias("found"))

    def run(batches):
        m = Model(**totals)
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):  # a row is megabytes
                words_, bigrams_ = (np.frombuffer(b"".join(x[c] for x in r["found"]), kind) for c, kind in (("n_words", np.int64), ("n_bigrams", np.float64)))
                yield _scored(m, r["ids"], r["held"], np.array(r["sizes"]), np.frombuffer(r["t"], np.uint64), lambda h, n=words_: n, lambda h, n=bigrams_: n)

    return chunks.drop("wanted").join(found, "chunk").mapInArrow(run, SCORED)


def score(docs: DataFrame, held_out: Column, blocks: int | None = None, vocabulary_limit: int = VOCABULARY_LIMIT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs``: doc_id, text; learns from the rows where ``held_out`` is false, scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    if blocks is None:  # a block's share of the input stays the same: a task holds one, with what is asked of it
        blocks = 1 << max(6, (BLOCKS_EACH * d.rdd.getNumPartitions() - 1).bit_length())
    counted = materialize(count_blocks(d.where(~F.col("held_out")), blocks), "lm-blocks", wide=True)
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_unigrams", "n_tokens", "n_bigrams", "n_single"))
    total = counted.agg(*sums, F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("n_bytes")).first()
    n_docs = d.where(~F.col("held_out")).count()
    gain = min(0.95, max(0.05, 1 - total["n_single"] / total["n_bigrams"])) if total["n_bigrams"] else 0.0
    totals = {"n": total["n_tokens"], "v": total["n_unigrams"], "n_docs": n_docs, "gain": gain}
    if total["n_unigrams"] > vocabulary_limit or total["n_bytes"] > broadcast_bytes:
        return _by_shuffle(d, totals, counted, blocks)
    parts = {r["block"]: (bytes(r["uh"]), bytes(r["un"]), bytes(r["bits"])) for r in counted.select("block", "uh", "un", "bits").toLocalIterator()}
    order = sorted(parts)
    vh, vn, bits = (np.frombuffer(b"".join(parts[k][i] for k in order), t) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
    sizes = np.array([8 * len(parts[k][2]) if k in parts else 0 for k in range(blocks)])
    return _by_broadcast(d, totals, spark.sparkContext.broadcast((vh, vn)), spark.sparkContext.broadcast((sizes, bits)))
