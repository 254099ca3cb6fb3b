"""Token-ID output as files of Re-Pair grammars, with random access.

Documents are put in order of their ids by a range shuffle, tokenized, and
written in blocks of about ``BLOCK_IDS`` ids.  Every block is a grammar of its
own: in rounds, pairs of neighbouring symbols that occur often become new
symbols, until no pair occurs ``LEAST`` times, a round gains next to nothing or
``ROUNDS`` are done.  A round
replaces many pairs at once: all pairs of the block are counted, of overlapping
occurrences the more frequent pair wins, and a pair becomes a rule if it still
occurs ``LEAST`` times.  Pairs never cross documents, so each document is a
stretch of symbols that decodes by itself.

The file format is Parquet with a row a block: the shard (the task that wrote
it, in order of ids), the block's place in it, the ids of the shard before the
block, the documents' ids, and one binary value:

    magic, counts (documents, rounds, symbols, rules, first new symbol), width of a symbol in bytes,
    first rule of each round, rules (left, right), expansion length of each rule,
    first symbol of each document, symbols of the block

Expansion lengths say how many ids a symbol stands for: ``slice_ids`` finds the
symbols of any stretch of ids by their running sum and expands only those.

Edge cases: null and empty texts are one end id; null doc_ids come first; rows
that repeat an id keep the order in which the table is read; a block holds whole
documents, so a very long one makes a block as long; an empty table gives no
files' rows and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch
from .packing import END_ID, text_tokenizer

#: Ids of a block, about; occurrences that make a pair a rule; rounds at most; a round that shortens a block by less is the last; buckets in which pairs are counted.
BLOCK_IDS, LEAST, ROUNDS, GAIN, BUCKETS = 1 << 18, 8, 8, 0.02, 1 << 18
MAGIC, HEAD = b"RPG1", "<4s5q1B"
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, grammar binary"


def grammar(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``ids`` of documents that begin at ``starts`` -> (symbols, the documents' first symbols, rules [left, right] of each round)."""
    s = ids.astype(np.uint32)
    first = np.zeros(len(s) + 1, bool)  # a document begins here
    first[starts] = True
    free = int(s.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    while len(rules) < rounds and len(s) > 1:
        pair = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)
        often = np.bincount(bucket, minlength=BUCKETS)[bucket].astype(np.int32)  # at least the pair's count
        often[first[1 : len(s)]] = 0
        # of overlapping occurrences the more frequent pair wins, of equal ones the first in a run of rising places
        wins = often >= least
        wins[1:] &= often[1:] > often[:-1]
        wins[:-1] &= often[:-1] >= often[1:]
        at = np.flatnonzero(wins)
        held = bucket[at]
        kinds = np.zeros(BUCKETS, np.uint64)
        kinds[held] = pair[at]  # of pairs that share a bucket one is replaced now, another in a later round
        own = kinds[held] == pair[at]
        at, held = at[own], held[own]
        good = np.bincount(held, minlength=BUCKETS) >= least
        if not good.any():
            break
        own = good[held]
        at, number = at[own], (np.cumsum(good) - 1)[held[own]]
        rules.append(np.stack([kinds[good] >> np.uint64(32), kinds[good] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        s[at] = free + number
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, first = s[keep], np.append(first[:-1][keep], False)
        free += len(rules[-1])
        if len(at) < GAIN * len(s):
            break
    return s, np.flatnonzero(first[:-1]), rules


def pack_block(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> bytes:
    """The binary value of a block."""
    base = int(ids.max(initial=0)) + 1
    symbols, docs, rules = grammar(ids, starts, least, rounds)
    firsts = np.cumsum([0, *map(len, rules)], dtype=np.int64)
    lengths = np.ones(base + int(firsts[-1]), np.uint32)
    for r, f in zip(rules, firsts):
        lengths[base + f : base + f + len(r)] = lengths[r].sum(1)
    flat = np.concatenate([np.empty((0, 2), np.uint32), *rules])
    width = 2 if base + len(flat) <= 1 << 16 else 4
    head = struct.pack(HEAD, MAGIC, len(docs), len(rules), len(symbols), len(flat), base, width)
    kind = f"<u{width}"
    return b"".join([head, firsts.astype("<i8").tobytes(), flat.astype(kind).tobytes(), lengths[base:].astype("<u4").tobytes(), docs.astype("<i8").tobytes(), symbols.astype(kind).tobytes()])


class Block:
    """A block's grammar, read from its binary value."""

    def __init__(self, data: bytes):
        magic, n_docs, n_rounds, n_symbols, n_rules, self.base, width = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a block of a grammar")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        kind = f"<u{width}"
        self.firsts = take("<i8", n_rounds + 1)
        self.rules = take(kind, 2 * n_rules).reshape(-1, 2).astype(np.uint32)
        self.lengths = take("<u4", n_rules)
        self.docs = take("<i8", n_docs)
        self.symbols = take(kind, n_symbols).astype(np.uint32)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every rule one after the other, and where each rule's begin."""
        s = np.arange(self.base, self.base + len(self.rules), dtype=np.uint32)
        for f in self.firsts[-2::-1] if len(self.rules) else ():  # rules of the last round first
            rule = s >= self.base + f
            if rule.any():
                more = np.repeat(s, 1 + rule)
                at = np.flatnonzero(rule) + np.arange(rule.sum())
                pair = self.rules[s[rule] - self.base]
                more[at], more[at + 1] = pair[:, 0], pair[:, 1]
                s = more
        return s, np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        rule = np.flatnonzero(s >= self.base)
        if not len(rule):
            return s
        ids, starts = self.table
        of = s[rule] - self.base
        n = self.lengths[of].astype(np.int64)
        size = np.ones(len(s), np.int64)
        size[rule] = n
        out = np.repeat(s, size)
        # the places of each rule's ids there, and in the table
        to = np.arange(n.sum()) + np.repeat(np.cumsum(size)[rule] - n - (np.cumsum(n) - n), n)
        out[to] = ids[np.arange(len(to)) + np.repeat(starts[of] - (np.cumsum(n) - n), n)]
        return out

    def sizes(self, s: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(s), np.int64)
        rule = s >= self.base
        out[rule] = self.lengths[s[rule] - self.base]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        end = self.docs[k + 1] if k + 1 < len(self.docs) else len(self.symbols)
        return self.expand(self.symbols[self.docs[k] : end])

    def documents(self) -> list[np.ndarray]:
        """The ids of each document."""
        ends = np.concatenate(([0], np.cumsum(self.sizes(self.symbols))))[np.append(self.docs, len(self.symbols))]
        ids = self.expand(self.symbols)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def slice_ids(self, start: int, stop: int) -> np.ndarray:
        """The block's ids from ``start`` to ``stop``; only the symbols that stand for them are expanded."""
        ends = np.cumsum(self.sizes(self.symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """``docs``: doc_id, text -> files under ``path``, documents in ascending order of their ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = text_tokenizer(tokenizer_path)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, names, size
            starts = np.cumsum([0, *(len(h) // 4 for h in held[:-1])])
            data = pack_block(np.frombuffer(b"".join(held), "<u4"), starts)
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            block, before, held, names, size = block + 1, before + size, [], [], 0
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "before", "n_ids", "doc_ids", "grammar"])

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                data = ids + end
                held.append(data)
                names.append(doc_id)
                size += len(data) // 4
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()

    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the files under ``path``, with start: the ids of all blocks before them."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # a row a shard, which is a task of the writing job: few, whatever the corpus
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Blocks of ``read`` -> doc_id, start, n_tokens, ids_crc32 (and ids if asked) of each document, decoded."""

    def run(batches):
        for b in batches:
            for start, doc_ids, data in zip(b.column("start").to_pylist(), b.column("doc_ids"), b.column("grammar")):
                ids = Block(data.as_py()).documents()
                n = np.array([len(i) for i in ids], np.int64)
                cols = [doc_ids.values, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())]
                cols += [pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.select("start", "doc_ids", "grammar").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def stretch(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    """Ids ``start`` to ``stop`` of the whole corpus by random access: at (place of the first), ids of each block that holds some."""

    def run(batches):
        for b in batches:
            for at, n, data in zip(b.column("start").to_pylist(), b.column("n_ids").to_pylist(), b.column("grammar")):
                ids = Block(data.as_py()).slice_ids(max(0, start - at), min(n, stop - at))
                yield pa.RecordBatch.from_arrays([pa.array([max(start, at)]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["at", "ids"])

    near = blocks.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return near.select("start", "n_ids", "grammar").mapInArrow(run, "at long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = scratch(spark, "repair")
    write(docs, path, tokenizer_path)
    return documents(read(spark, path))
