"""Vector codes, Re-Pair files and prefix tries against plain versions, with the awkward rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import prefix_trie, registry, repair, vector_codes
from tracewell.llm.packing import text_tokenizer

MOST = (1 << 63) - 1
VECTORS = "vec_id long, embedding array<double>, label string, code int, x string"


def plain_codes(rows, entries, rounds, parts=4):
    """rows: (vec_id, vector, label) of one length that parts divide."""
    kept = [(i, [math.floor(1024 * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda x: [tuple(x[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for r in kept:
                x = cut(r[1])[p]
                own[near(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), MOST), lab))
    sums = collections.Counter()
    for r in out:
        sums[r[3]] += r[2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((*r[:3], min(sums[r[3]], MOST), sha) for r in out)


@pytest.mark.parametrize("scale,entries", [(1.0, 8), (0.002, 8), (1e15, 5)])
def test_vector_codes(spark, scale, entries):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.standard_normal(12) * scale).tolist(), ("a", "b", None)[i % 3]) for i in rng.permutation(90)]
    rows += [(200 + i, rows[4][1], "a") for i in range(60)]  # a third are copies
    rows += [(300, None, "a"), (301, [math.nan] * 12, "a"), (302, [None] + [1.0] * 11, None), (303, [math.inf] + [0.0] * 11, "b"), (5, rows[7][1], "b"), (5, rows[8][1], "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    codes, books = vector_codes.compress(df, entries=entries)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.with_label_error(codes).collect()]
    assert sorted(got) == plain_codes(rows, entries, vector_codes.ROUNDS)
    if scale == 1.0:
        back = {r["vec_id"]: r["x"] for r in vector_codes.decompress(codes.where("vec_id < 5"), books[12]).collect()}
        error = {r[0]: r[2] for r in got}
        vectors = {r[0]: r[1] for r in rows}
        assert back and all(sum((math.floor(1024 * a) - b) ** 2 for a, b in zip(vectors[i], x)) == error[i] for i, x in back.items())


def test_vector_code_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None, 0, ""), (None, [5.0, 2.0, 3.0, 4.0], None, 0, ""), (1, [1.5] * 6, "a", 0, ""), (2, [], "a", 0, ""), (3, [1e300] * 4, "b", 0, "")], VECTORS)
    codes, books = vector_codes.compress(df)
    got = sorted(map(str, ((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_error(codes).collect())))
    # each vector of a length is an entry of its own: ids before null ones, ties by components
    want = [(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "00000000", 0, 0), (None, "01010101", 0, 0), (None, "02010101", 0, 0)]
    assert got == sorted(map(str, want))
    assert set(books) == {0, 4, 6}
    empty, none = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert vector_codes.with_label_error(empty).count() == 0 and none == {}


def test_walk_shares_prefixes():
    rng = np.random.default_rng(5)
    parts, back = vector_codes.sorted_rows(rng.integers(-2, 3, (3000, 6)).astype(float))
    entries = rng.integers(-2, 3, (40, 6))
    at, far = vector_codes.nearest(parts, entries)
    want = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (at == want.argmin(1)).all() and (far == want.min(1)).all() and len(back) == 3000
    seen = np.concatenate([rows for rows, _, _ in vector_codes.walk(parts.astype(np.int64), entries)])
    assert sorted(seen) == list(range(len(parts)))


DOCS = "doc_id long, text string, start string, shard int"


def test_repair_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(200)]
    texts = [None, "", " \n", "One, two!", "É ß \U0001f600 <|endoftext|> x"] + [" ".join(rng.choice(vocab, n)) for n in rng.integers(1, 400, 60)] + [" ".join(rng.choice(vocab, 30_000))]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts)] + [(None, "no id"), (None, "no id"), (6, "again")]
    path = registry.vocabulary_file("word_bpe_49k.json")
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS).repartition(5)
    out = str(tmp_path / "ids")
    repair.write(docs, out, path, block_ids=3000)
    blocks = repair.read(spark, out)
    assert blocks.count() > 5
    got = repair.documents(blocks, with_ids=True).collect()
    encode = text_tokenizer(path)
    ids = lambda t: [*np.frombuffer(next(encode(pa.array([t], pa.string()))), "<u4").tolist(), 1]
    want = collections.Counter((d, tuple(ids(t))) for d, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    at, corpus = 0, []
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        corpus += r["ids"]
    for a, b in ((0, 1), (2990, 3010), (0, len(corpus)), (len(corpus) - 1, len(corpus)), (500, 9000)):
        parts = sorted((r["at"], r["ids"]) for r in repair.stretch(blocks, a, b).collect())
        assert [i for _, p in parts for i in p] == corpus[a:b]
    assert repair.round_trip(spark.createDataFrame([], DOCS), path).count() == 0


@pytest.mark.parametrize("least,rounds", [(2, 30), (4, 3), (10**9, 5)])
def test_grammar_expands_to_its_ids(least, rounds):
    rng = np.random.default_rng(least)
    ids = np.concatenate([np.tile(rng.integers(0, 5, 7), 40), rng.integers(0, 4, 3000), np.full(501, 7), rng.integers(0, 70000, 50)]).astype(np.uint32)
    starts = np.unique(np.concatenate(([0], rng.integers(0, len(ids), 30))))
    block = repair.Block(repair.pack_block(ids, starts, least, rounds))
    assert [x.tolist() for x in block.documents()] == [x.tolist() for x in np.split(ids, starts[1:])]
    assert block.document(3).tolist() == ids[starts[3] : starts[4]].tolist() and block.document(len(starts) - 1).tolist() == ids[starts[-1] :].tolist()
    assert (block.sizes(block.symbols).sum() == len(ids)) and (len(block.symbols) < len(ids)) == (least < 10**9)
    for r, n in zip(block.rules, block.lengths):
        assert len(block.expand(np.array(r))) == n
    # a left part before a right one: nothing is replaced twice
    for a, b in rng.integers(0, len(ids) + 1, (50, 2)):
        assert block.slice_ids(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()


CONVERSATIONS = "conv_id long, turn long, role string, text string, keys string, depth int"


def plain_nodes(convs):
    """convs: {conv_id: [(role, text)]} -> rows of every node."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def node_rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def conversations(spark):
    rng = np.random.default_rng(4)
    words = ["hi", "é", "", None, "what now", "x" * 50, "yes"]
    rows = []
    for c in [*range(-7, 120), 10**12]:
        if c in (20, 40):
            continue  # their families have no first conversation
        for t in range(int(rng.integers(1, 12)) if c % 7 else 1):
            rows.append((c, None if t == 0 and c % 11 == 0 else t, ("user", "assistant", None)[t % 3], words[min(6, int(rng.geometric(0.5)) - 1)]))
    rows += [(c, t, "user", "the same") for c in range(200, 300) for t in range(9)]  # copies
    rows += [(301, t, "user", f"long {t % 3}") for t in range(700)] + [(302, 5, "a", "tie"), (302, 5, "b", "tie"), (302, 5, "b", "tie"), (None, 1, "a", "nobody")]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([(*rows[i], "k", 1) for i in order], CONVERSATIONS)


def plain_rebuilt(df):
    own = collections.defaultdict(list)
    for r in df.collect():
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, tie, (role, text)))
    plain = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, seq in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - int(math.fmod(c, 5)), [])[:h] + seq[h:]
    return plain, out


@pytest.mark.parametrize("shard_turns", [1 << 18, 60])
def test_prefix_trie(spark, conversations, shard_turns):
    plain, rebuilt = plain_rebuilt(conversations)
    lists = prefix_trie.turns(conversations)
    assert node_rows(prefix_trie.prefix_trie(conversations, shard_turns)) == plain_nodes(plain)
    assert any(not s for s in rebuilt.values())
    assert node_rows(prefix_trie.nodes(prefix_trie.rebuilt(lists), shard_turns)) == plain_nodes(rebuilt)
    assert prefix_trie.prefix_trie(conversations.limit(0)).count() == 0


def test_stored_arrays_lead_to_their_nodes(spark, conversations):
    """The table's BASE and CHECK are the arrays: every node is its parent's BASE plus a turn id, in its shard."""
    rows = prefix_trie.prefix_trie(conversations, 1 << 18).collect()
    slots = {(r["shard"], r["slot"]): r for r in rows}
    assert len(slots) == len(rows)
    inner = [r for r in rows if r["check"] is not None and (r["shard"], r["check"]) in slots]
    turn_ids = collections.defaultdict(set)
    for r in inner:
        turn_ids[r["shard"], bytes(r["turn_key"])].add(r["slot"] - slots[r["shard"], r["check"]]["base"])
        assert slots[r["shard"], r["check"]]["depth"] == r["depth"] - 1
    assert inner and all(len(x) == 1 for x in turn_ids.values())


def test_double_array():
    rng = np.random.default_rng(6)
    key = lambda k: int(k).to_bytes(prefix_trie.KEY, "big")
    paths = sorted({b"".join(map(key, rng.integers(0, 30, rng.integers(0, 6)))) for _ in range(400)})
    trie = prefix_trie.DoubleArray(paths)
    prefixes = {p[:k] for p in paths for k in range(0, len(p) + 1, prefix_trie.KEY)}
    slots = {trie.find(p) for p in prefixes}
    assert -1 not in slots and len(slots) == len(prefixes) == (trie.check != -1).sum()
    assert trie.find(key(31)) == -1 and all(trie.find(p + key(40)) == -1 for p in paths)
    assert len(trie.check) < 1.2 * len(prefixes) + 30
