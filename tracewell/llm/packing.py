"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become token ids, an end id is appended, and only what is longer than
a sequence is cut.  Packing then needs the pieces' lengths alone, and of these
only the histogram (at most ``capacity`` rows), which goes to the driver:

1. patterns of two to four lengths that fill a sequence (nearly) are enumerated;
2. repeat counts are fitted to the histogram by non-negative least squares and
   rounded down, never beyond what the histogram holds;
3. what is left is packed best-fit: the longest length opens a sequence, the
   longest that still fits follows, and the fill is repeated as often as the
   counts allow, so this too takes no more steps than there are lengths.

Pieces get their places by rank: the r-th piece of a length takes the r-th slot
of that length.  Ranks come from counts by (length, salt), so a length that
holds a third of all pieces is ranked by many tasks.

Edge cases: null and empty texts are one end id; repeated rows are packed one
by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, END_ID = 4096, 1
#: Pieces that one salt of a length holds at most, about: a salt is ranked by one task.
SALT_PIECES = 1 << 18
#: Pattern search: middle lengths tried for each first length, worst waste allowed, sweeps of the fit.
MIDDLES, WASTE, SWEEPS = 6, 0.004, 12
#: Bytes of memory for the ids of words that a worker remembers, about (two generations of half of it, and the words of one text), and of one word besides its letters.
CACHE_BYTES, ENTRY_BYTES = 1 << 28, 220
#: Bytes of text whose words are looked up at once, one text at least.
SLICE_BYTES = 6 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _process_cache(name: str) -> dict:
    """A dict that lives as long as the worker's process, which runs many tasks."""
    import sys
    import types

    return sys.modules.setdefault("tracewell_worker_cache", types.ModuleType("tracewell_worker_cache")).__dict__.setdefault(name, {})


def text_tokenizer(path: str, cache_bytes: int | None = None, slice_bytes: int | None = None):
    """pa.Array of texts -> the little-endian uint32 ids of each, in turn, remembering the ids of words.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text's
    ids are those of its words in turn; texts that may hold a special token's
    string are encoded whole.  Words are split by numpy and numbered by Arrow, each
    distinct word of a slice of texts is looked up once, and the ids are put together
    by numpy.  Words of Latin letters, digits and ASCII punctuation are cut into
    their pre-tokens, which go to the tokenizer's model directly; any other word goes
    through the whole tokenizer.  When the young generation of remembered words is full it
    becomes the old one; words met again move on, the rest go.  ``cache_bytes`` and
    ``slice_bytes`` (by default ``CACHE_BYTES`` and ``SLICE_BYTES``) bound a worker's memory.
    """
    from array import array

    cache_bytes, slice_bytes = cache_bytes or CACHE_BYTES, slice_bytes or SLICE_BYTES

    cache = _process_cache(f"ids {path}")
    if "tokenizer" not in cache:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        cache |= {"tokenizer": tok, "young": {}, "old": {}, "bytes": 0}
    tok = cache["tokenizer"]
    tokenize = tok.model.tokenize
    # pre-tokens of these words: runs of letters, single digits, runs of punctuation (but for the apostrophe, which may join what follows it)
    letters, marks = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
    plain, mixed = re.compile(f"([{letters}]+)([{marks}]*)").fullmatch, re.compile(f"[{letters}0-9{marks}]+").fullmatch
    parts = re.compile(f"[{letters}]+|[0-9]|[{marks}]+").findall
    # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(s: str) -> bytes:
        return array("I", [t.id for t in tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(alphabet))]).tobytes()

    def ids_of(new: list[str]) -> dict[str, bytes]:
        young, old, out, other = cache["young"], cache["old"], {}, []

        def known(s: str) -> bytes:
            """The ids of a pre-token, which may be a word by itself."""
            if (ids := out.get(s)) is None and (ids := young.get(s)) is None:
                ids = old.get(s)
                out[s] = ids = piece(s) if ids is None else ids
            return ids

        for w in new:
            if (ids := old.get(w)) is None:
                if m := plain(w):
                    stem, end = m.groups()
                    ids = known(stem.lower())
                    if end:
                        ids += known(end)
                elif mixed(w):
                    ids = b"".join(map(known, parts(w.lower())))
                else:
                    other.append(w)
                    continue
            out[w] = ids
        if other:
            found = tok.encode_batch(other, add_special_tokens=False)
            out.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, found))
        return out

    def lookup(words: list[str]) -> list[bytes]:
        seen = cache["young"]
        ids = list(map(seen.get, words))
        if None in ids:
            found = ids_of([w for w, i in zip(words, ids) if i is None])
            ids = [found[w] if i is None else i for w, i in zip(words, ids)]
            cache["bytes"] += ENTRY_BYTES * len(found) + sum(map(len, found)) * 2
            seen |= found
            if cache["bytes"] > cache_bytes // 2:
                cache.update(old=seen, young={}, bytes=0)
        return ids

    def some(texts: pa.Array) -> list[bytes]:
        """``texts``: large strings, none null."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        inside = ~_BLANK[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = (offsets - offsets[0])[:-1]
        edge = edge[edge < len(data)]
        begins[edge] = inside[edge]
        # the words one after the other, without what parts them
        starts = np.append(np.flatnonzero(begins[inside]), inside.sum())
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[inside])).dictionary_encode()
        ids = lookup(words.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), words.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int64)
        kind = np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64
        places = np.arange(len(n) and ends[-1], dtype=kind) + np.repeat(((np.cumsum(size, dtype=np.int64) - size)[at] - (ends - n)).astype(kind), n)
        out = flat[places].tobytes()
        of = np.concatenate(([0], np.cumsum(begins)))[offsets - offsets[0]]  # words before each text
        cut = (4 * np.concatenate(([0], ends))[of]).tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def encode(texts: pa.Array) -> Iterator[bytes]:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(texts):  # slices of some bytes, one text at least
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + slice_bytes, "right")))
            part = pc.fill_null(texts[lo:hi].cast(pa.large_string()), "")
            marked = pc.match_substring(part, "<|").to_numpy(zero_copy_only=False)
            if marked.any():
                plain_ = some(pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), part))
                yield from (array("I", tok.encode(part[i].as_py(), add_special_tokens=False).ids).tobytes() if m else ids for i, (m, ids) in enumerate(zip(marked, plain_)))
            else:
                yield from some(part)
            lo = hi

    return encode


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_bytes: int | None = None, slice_bytes: int | None = None) -> DataFrame:
    """``docs``: doc_id, text -> one row a piece: doc_id, piece, start, length, ids_crc32 (and ids array<int> if asked)."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = text_tokenizer(tokenizer_path, cache_bytes, slice_bytes)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                data = ids + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names[: len(cols)])
        if cache_bytes:  # a worker outlives its task: what it remembers goes
            _process_cache(f"ids {tokenizer_path}").update(young={}, old={}, bytes=0)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _candidates(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of two to four lengths as rows of indices into ``lengths`` (-1: none)."""
    n = len(lengths)
    mass = np.cumsum(counts) / counts.sum()
    at_most = lambda room: np.searchsorted(lengths, room, "right") - 1  # noqa: E731  index of the longest that fits
    first = np.arange(n)
    out = []
    quantiles = (np.arange(MIDDLES) + 0.5) / MIDDLES
    middles = np.unique(np.minimum(np.searchsorted(mass, quantiles), n - 1))
    for mid in [(), *((m,) for m in middles), *((a, b) for i, a in enumerate(middles) for b in middles[i:])]:
        room = capacity - lengths[first] - sum(int(lengths[m]) for m in mid)
        last = at_most(room)
        ok = (last >= 0) & (room - lengths[np.maximum(last, 0)] <= WASTE * capacity)
        rows = np.full((int(ok.sum()), 4), -1, np.int64)
        rows[:, 0], rows[:, 1] = first[ok], last[ok]
        for j, m in enumerate(mid):
            rows[:, 2 + j] = m
        out.append(np.sort(rows, 1))
    return np.unique(np.concatenate(out), axis=0)


def fit_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The histogram -> [(pattern {length: how many}, repeats)], using every piece exactly once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    full = lengths == capacity
    if full.any():
        out.append(({capacity: 1}, int(left[full][0])))
        left[full] = 0
    open_ = np.flatnonzero(left > 0)
    if len(open_) > 1:
        pats = [{k: p.count(k) for k in p} for p in ([int(open_[i]) for i in row if i >= 0] for row in _candidates(lengths[open_], left[open_], capacity).tolist())]
        # coordinate descent on ||A x - h||^2, x >= 0: A's column is a pattern's counts, r = h - A x
        r, x = left.astype(float).tolist(), [0.0] * len(pats)
        cols = [(list(p.items()), float(sum(m * m for m in p.values()))) for p in pats]
        for _ in range(SWEEPS):
            for j, (items, norm) in enumerate(cols):
                step = max(-x[j], sum(m * r[k] for k, m in items) / norm)
                if step:
                    x[j] += step
                    for k, m in items:
                        r[k] -= m * step
        for j in sorted(range(len(pats)), key=lambda j: -x[j]):
            reps = min(int(x[j] + 1e-9), *(int(left[k]) // m for k, m in pats[j].items()))
            if reps > 0:
                for k, m in pats[j].items():
                    left[k] -= m * reps
                out.append(({int(lengths[k]): m for k, m in pats[j].items()}, reps))
    return out + best_fit(lengths, left, capacity)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Longest first, each time the longest that fits; a fill is repeated while its pieces last."""
    lens, left = lengths.tolist(), counts.tolist()
    alive = [i for i in range(len(lens)) if left[i] > 0]
    out = []
    while alive:
        room, fill = capacity, {}
        k = len(alive) - 1
        while k >= 0:
            i = alive[k]
            m = min(left[i], room // lens[i])
            if m > 0:
                fill[i] = m
                room -= m * lens[i]
            k = min(k - 1, _below(alive, lens, room))
        reps = min(left[i] // m for i, m in fill.items())
        for i, m in fill.items():
            left[i] -= m * reps
        out.append(({lens[i]: m for i, m in fill.items()}, reps))
        alive = [i for i in alive if left[i] > 0]
    return out


def _below(alive: list[int], lens: list[int], room: int) -> int:
    """Place in ``alive`` of the longest length of at most ``room``."""
    lo, hi = 0, len(alive)
    while lo < hi:
        mid = (lo + hi) // 2
        if lens[alive[mid]] <= room:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Of each length the runs of ranks that go to one pattern, sorted by (length, first rank)."""
    rows, base, used = [], 0, {}
    for pattern, reps in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            m = pattern[length]
            rows.append((length, used.get(length, 0), base, at, m))
            used[length] = used.get(length, 0) + reps * m
            at += length * m
        base += reps
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "offset", "times"), a.T.copy()))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_bytes: int | None = None, slice_bytes: int | None = None) -> DataFrame:
    """``docs``: doc_id, text -> the pieces with their sequence_id and offset. The last two bound a worker's memory, see ``text_tokenizer``; with the first, words are forgotten with the task."""
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id, with_ids, cache_bytes, slice_bytes), "pieces")
    salts = max(64, -(-pieces.count() // SALT_PIECES))  # as if all pieces had one length
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    hist = by_salt.groupBy("length").agg(F.sum("n").alias("n")).toPandas().sort_values("length")
    table = slots(fit_patterns(hist["length"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), capacity))
    # at most a few runs for each length and pattern: bounded by the capacity, not by the corpus
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = p.withColumn("nth", nth).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted((t["length"] << 44) + t["rank"], (n << 44) + r, "right") - 1
        q = r - t["rank"][i]
        return pd.DataFrame({"sequence_id": t["base"][i] + q // t["times"][i], "offset": t["offset"][i] + (q % t["times"][i]) * n})

    out = ranked.withColumn("place", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"), *(["ids"] if with_ids else []))
