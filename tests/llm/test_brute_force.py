"""The dealt operators against brute force on small fixtures, with the awkward rows."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracewell.llm import ann, langid, lm_scoring, media, mixing, packing, registry, simhash, token_counts, url_filters, warc
from tracewell.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _words int, kept boolean"


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[i % len(sources)], None, None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    out = [None, "", " \t\n ", "one", "one two three", "ONE two three", "É ß \U0001f600 x"]
    base = [" ".join(rng.choice(vocab, n)) for n in (5, 30, 80, 80, 200, 400, 3000)]
    out += base
    out += [base[3], base[3], base[4].upper()]
    for k in (1, 2, 3):  # near copies
        w = base[5].split()
        for j in rng.choice(len(w), k, replace=False):
            w[j] = "changed"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), DOCS)


def roots(n, linked):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, k):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, texts):
    fp = [plain_fingerprint(t, 4) for t in texts]
    want = roots(len(texts), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = {r["doc_id"]: r for r in simhash.dedupe(docs).collect()}
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fp
    assert [got[i]["component_id"] for i in range(len(texts))] == want


@pytest.mark.parametrize("equal", [1, 3, 5])
def test_simhash_links_random(spark, equal):
    rng = np.random.default_rng(equal)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = [int(b) for b in base]
    for b in base[:20]:
        x = int(b)
        for _ in range(6):  # chains: each step flips up to four bits
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted({(f + (1 << 63)) % (1 << 64) - (1 << 63) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 4)
    for chunk in (1 << 14, 2):  # cells cut into pairs of chunks connect the same
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, equal, chunk)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[w] for w in want]


def test_large_cell_gives_a_forest(spark):
    rng = np.random.default_rng(3)
    fps = np.unique([int(sum(1 << int(b) for b in rng.choice(8, 2, replace=False))) | (int(rng.integers(0, 4)) << 60) for _ in range(400)])
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, 1)).collect()}
    want = roots(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 4)
    assert [got.get(int(f), int(f)) for f in fps] == [int(fps[w]) for w in want]


def test_popcounts_bound_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 2000), dtype=np.int64)
    d = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert (d <= np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))).all() and d.max() > 10


def test_keep_one_by_similarity(spark, docs, texts):
    s = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for t in texts]
    alike = lambda i, j: s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])
    want = sorted(set(roots(len(texts), alike)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_simhash_empty_and_null_ids(spark):
    assert simhash.dedupe(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b c d", *[None] * 5), (None, "x y z w", *[None] * 5), (3, "a b c d", *[None] * 5)], DOCS)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.dedupe(df).collect()) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_mixing_targets_and_limits(spark, texts):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), "en", s, None, None, None) for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["low"] * 50 + [None] * 9)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, block_docs=16, shards=5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    order = sorted([k for k in size if k is not None]) + [None]
    weight = dict(zip(order, (5, 2, 1, 5)))
    target, open_, left = {}, set(size), sum(size.values())
    while True:  # reshare until none is above three times its size
        w = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / w >= 3 * size[k]}
        if not over:
            target |= {k: left * weight[k] / w for k in open_}
            break
        for k in over:
            target[k] = 3.0 * size[k]
        left -= sum(target[k] for k in over)
        open_ -= over
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["shards"]) == r["copies"] and all(0 <= s < 5 for s in r["shards"])
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    for k in size:
        assert abs(taken[k] - target[k]) <= 0.05 * target[k]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, block_docs=16, shards=5).collect()))


def test_splitting_tree_is_hypergeometric(spark):
    q = spark.createDataFrame([(1, 40), (2, 25), (3, 0), (4, 3)], "rank int, units long")
    leaves = collections.defaultdict(dict)
    for r in mixing.split_quotas(q, 6).collect():
        leaves[r["shard"]][r["rank"]] = r["units"]
    assert len(leaves) == 6 and all(v >= 0 for x in leaves.values() for v in x.values())
    assert [sum(x[k] for x in leaves.values()) for k in (1, 2, 3, 4)] == [40, 25, 0, 3]
    sizes = [sum(x.values()) for x in leaves.values()]
    assert max(sizes) - min(sizes) <= 2
    # the first draw's distribution over many seeds: mean and variance of a hypergeometric
    from pyspark.sql import functions as F

    draws = spark.range(4000).select(mixing._hypergeometric(F.lit(68), F.lit(40), F.lit(34), mixing._uniform(F.lit(9), F.col("id"))).alias("k")).toPandas()["k"]
    mean, var = 34 * 40 / 68, 34 * (40 / 68) * (28 / 68) * (34 / 67)
    assert abs(draws.mean() - mean) < 0.15 and abs(draws.var() - var) < 0.5


def test_mixing_edges(spark, docs):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert collections.Counter(r["doc_id"] for r in out.collect()) == want


def test_packing_round_trip(spark, docs, texts):
    path = registry.vocabulary_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    cap = 512
    got = packing.pack(docs, path, capacity=cap, with_ids=True).collect()
    by_doc, by_seq, total = collections.defaultdict(dict), collections.defaultdict(list), 0
    for r in got:
        by_doc[r["doc_id"]][r["piece"]] = r
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        assert [x for k in sorted(by_doc[i]) for x in by_doc[i][k]["ids"]] == ids
        for k, r in by_doc[i].items():
            assert r["start"] == k * cap and r["length"] == min(cap, len(ids) - k * cap)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for places in by_seq.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= cap
    assert len(by_seq) <= math.ceil(total / cap) + 2


def test_word_ids_equal_whole_text_ids():
    path = registry.vocabulary_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(path), packing.text_tokenizer(path)
    texts = ("Don't it's x á ́b 't", "  a<|endoftext|>b ", "ΑΣ Σας İx\x1cy\x85z 12,3!? \U0001f600", "a\x0bb\x0cc d", "ﬁ ½ Å Å naïve, Straße; WORD!?.", "", " ", None, "\u00a0x\u3000y\u0085", "x" * 9000)
    want = [np.array(tok.encode(s or "", add_special_tokens=False).ids, "<u4").tobytes() for s in texts]
    assert list(encode(pa.array(texts))) == list(encode(pa.array(texts))) == want and list(encode(pa.array([None, *texts]).slice(1))) == want
    assert list(encode(pa.array([], pa.string()))) == [] and list(encode(pa.array([None], pa.string()))) == [b""]


def test_words_are_remembered_in_bounded_memory(monkeypatch):
    from tokenizers import Tokenizer

    path = registry.vocabulary_file("word_bpe_49k.json")
    tok, encode, cache = Tokenizer.from_file(path), packing.text_tokenizer(path), packing._process_cache(f"ids {path}")
    monkeypatch.setattr(packing, "CACHE_BYTES", 40_000)
    monkeypatch.setattr(packing, "SLICE_BYTES", 500)
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdeé,"), 6)) for _ in range(40)) for _ in range(100)]
    assert list(encode(pa.array(texts))) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(cache["young"]) < 200 and len(cache["old"]) < 200


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(0)
    for mean in (40, 900, 2500):
        n = np.minimum(rng.geometric(1 / mean, 5000), 4096)
        lengths, counts = np.unique(n, return_counts=True)
        used = collections.Counter()
        bins = 0
        for pattern, reps in packing.fit_patterns(lengths, counts):
            assert sum(k * m for k, m in pattern.items()) <= 4096
            bins += reps
            for k, m in pattern.items():
                used[k] += m * reps
        assert used == dict(zip(lengths.tolist(), counts.tolist()))
        big = int((n > 2048).sum())
        assert bins <= max(math.ceil(n.sum() / 4096), big) * 1.02 + 1


def test_media_round_trip(docs, texts):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    seen = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = media.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(t or "", r["feature"]) == r["feature"]
    assert len({media.encode(p)[:2] + media.encode(p)[28:29] for p in (bytes([k]) * 576 for k in range(60))}) >= 3


def test_media_feature_in_full():
    """The 64 bits from the decoded samples, each cell's mean as a fraction."""
    from fractions import Fraction

    rng = np.random.default_rng(8)
    for n in (10, 576, 700, 3000, 6000):
        payload, _ = media.payload_of("".join(map(chr, rng.integers(32, 1000, n))))
        image = media.decode(media.encode(payload)).astype(int)
        grey = image if image.ndim == 2 else image.sum(2)  # thirds: the factor changes no comparison
        h, w = grey.shape

        def mean(y, x):  # of the area below a cell of the 9 x 8 grid
            total = Fraction(0)
            for i in range(h * y // 8, -(-h * (y + 1) // 8)):
                for j in range(w * x // 9, -(-w * (x + 1) // 9)):
                    tall = min(Fraction(i + 1), Fraction(h * (y + 1), 8)) - max(Fraction(i), Fraction(h * y, 8))
                    wide = min(Fraction(j + 1), Fraction(w * (x + 1), 9)) - max(Fraction(j), Fraction(w * x, 9))
                    total += tall * wide * int(grey[i, j])
            return total

        bits = "".join(str(int(mean(y, x + 1) > mean(y, x))) for y in range(8) for x in range(8))
        assert f"{media.difference_hash(media.decode(media.encode(payload))):064b}" == bits


def test_media_other_formats(spark):
    import struct

    assert media.decode(b"P1 3 2 101 # c\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n10 2\n" + bytes([0b10000000, 0b01000000, 0, 0])).tolist() == [[0] + [255] * 8 + [0], [255] * 10]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]] and media.decode(b"P5 2 1 100 " + bytes([50, 100])).tolist() == [[128, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]] and media.decode(b"P5 1 1 65535 \x01\x02").tolist() == [[258]] and media.decode(b"P2 1 1 0 0") is None
    # a version 4 header before the palette; masks of 16 and 32 bits
    info = struct.pack("<IiiHHIIiiII", 108, 1, 1, 1, 8, 0, 4, 0, 0, 2, 0) + bytes(68)
    assert media.decode(struct.pack("<2sIHHI", b"BM", 0, 0, 0, 14 + 108 + 8) + info + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + bytes([1, 0, 0, 0])).tolist() == [[[7, 8, 9]]]
    for bits, masks, pixel in ((16, (0xF800, 0x7E0, 0x1F), 0xF800), (32, (0xFF, 0xFF00, 0xFF0000), 0xFF)):
        info = struct.pack("<IiiHHIIiiII", 40, 1, -1, 1, bits, 3, 4, 0, 0, 0, 0) + struct.pack("<III", *masks)
        assert media.decode(struct.pack("<2sIHHI", b"BM", 0, 0, 0, 66) + info + struct.pack("<I", pixel)).tolist() == [[[255, 0, 0]]]
    assert media.media_columns(spark.createDataFrame([], DOCS)).count() == 0


def test_media_resize_and_formats():
    rng = np.random.default_rng(1)
    for h, w, th, tw in ((24, 24, 8, 9), (5, 3, 16, 16), (7, 11, 4, 5)):
        img = rng.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.kron(img.astype(float), np.ones((th, tw)))  # every target cell is h x w of these
        want = fine.reshape(th, h, tw, w).mean((1, 3))
        assert np.allclose(media.area_resize(img, tw, th), want)
    assert media.decode(b"P2\n# note\n2 2\n255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"nothing") is None and media.decode(None) is None and media.decode(b"BM") is None
    import io

    assert np.load(io.BytesIO(media.npy_tile(np.full((9, 9), 7, np.uint8)))).tolist() == np.full((16, 16), 7).tolist()


def test_warc_round_trip(spark):
    long_a, long_b = "é<p>" * 900, "x" * 50_000
    pages = [(1, "http://a/", long_a), (2, None, long_a), (9, "http://b/\r\nX: y", long_a), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long_b), (8, "u", "WARC/1.0\r\n\r\n0\r\n\r\n" * 80), (None, "u", "n" * 2000), (7, "u", long_b)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, type string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        top = max((p[0] for p in pages if p[2] == h and p[0] is not None), default=None)
        revisit = len(b) >= 1000 and top is not None and i != top
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_damage():
    payload = bytes(range(256)) * 40
    assert warc.unchunk(warc.chunked(payload)) == payload and warc.unchunk(b"zz\r\n") is None and warc.unchunk(b"5\r\nab") is None
    recs = warc.records_of(5, "5:0", "u", payload, "d", None, "2024", 4096)
    assert len(recs) > 2
    parsed = list(warc.parse(b"\r\n\r\n".join(recs) + b"\r\n\r\n"))
    assert [f["warc-segment-number"] for f, _ in parsed] == [str(i + 1) for i in range(len(recs))]
    block = b"".join(b for _, b in parsed)
    assert warc.payload_of(block) == payload and int(parsed[-1][0]["warc-segment-total-length"]) == len(block)


def test_token_counts_against_plain_dp(docs, texts):
    path = registry.vocabulary_file("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)

    def plain(w):
        best, used = [0.0], [0]
        for e in range(1, len(w) + 1):
            top, n = -math.inf, 0
            for b in range(e):
                s = scores.get(w[b:e])
                if s is not None and best[b] + s > top:
                    top, n = best[b] + s, used[b] + 1
            if top == -math.inf:
                top, n = best[e - 1] + token_counts.UNKNOWN, used[e - 1] + len(w[e - 1].encode())
            best.append(top)
            used.append(n)
        return used[-1]

    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect()}
    cache = {}
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        for x in w:
            if x not in cache:
                cache[x] = plain(token_counts.MARK + x)
        assert got[i] == (len(w), sum(cache[x] for x in w))


def test_lm_against_exact_counts(spark, docs, texts):
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    toks = [[*words(t), "END"] for t in texts]
    uni = collections.Counter(x for i, w in enumerate(toks) if i not in held for x in w)
    n, v = sum(uni.values()), len(uni)
    from pyspark.sql import functions as F

    mark = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    # the model in plain Python, with counts floored to powers of two; a false level can only raise a bigram's count
    pairs = collections.Counter(p for i, w in enumerate(toks) if i not in held for p in zip(["START", *w], w))
    n_docs = len(texts) - len(held)
    gain = min(0.95, max(0.05, 1 - sum(c == 1 for c in pairs.values()) / sum(pairs.values())))

    def plain(w, count):
        out = 0.0
        for v, x in zip(["START", *w], w):
            before, base = n_docs if v == "START" else uni[v], (uni[x] + 1) / (n + 1 * (v_ + 1))
            p = base * (1 - gain) if before else base
            out += math.log10(p + (gain * min(count(v, x), uni[x], before) / before if before and uni[x] else 0))
        return out

    v_ = v
    floored = lambda a, b: 2.0 ** math.floor(math.log2(pairs[a, b])) if pairs[a, b] else 0
    results = []
    for options in ({}, {"vocabulary_limit": 0}, {"broadcast_bytes": 8}):  # by broadcast, by shuffle, and a filter beyond its bound
        got = {r["doc_id"]: r for r in lm_scoring.score(docs, mark, **options).collect()}
        for i, w in enumerate(toks):
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(uni[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + 1) / (n + 1 * (v + 1))) for x in w))
            assert plain(w, floored) - 1e-6 <= r["score"] <= plain(w, lambda a, b: math.inf) + 1e-6
        exact = sum(abs(got[i]["score"] - plain(w, floored)) < 1e-6 * len(w) for i, w in enumerate(toks))
        assert exact >= 0.5 * len(toks)
        results.append({i: round(r["score"], 6) for i, r in got.items()})
    assert results[0] == results[1] == results[2]
    assert lm_scoring.score(spark.createDataFrame([], DOCS), mark).count() == 0


def test_bloom_filter_counts():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    c = rng.geometric(0.3, len(h))
    bits = lm_scoring.filter_block(h, c)
    f = lm_scoring.Filter(np.array([8 * len(bits)]), np.frombuffer(bits, np.uint8))
    got = f.count(h)
    assert (got >= 2.0 ** np.floor(np.log2(c))).all()  # never below its level
    assert (got == 2.0 ** np.floor(np.log2(c))).mean() > 0.9
    assert (f.count(rng.integers(0, 1 << 64, 20000, dtype=np.uint64)) > 0).mean() < 0.06


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [None] * 16, 0), (2200, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = d @ d[q]
        want = sorted((-round(s[j], 9), j) for j in range(1500) if j != q)[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(v != q for _, v, _ in got[q])
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in got[q])
        hits += len({v for _, v, _ in got[q]} & {j for _, j in want})
    assert set(got) == set(range(0, 1500, 50)) and hits >= 0.9 * 150
    assert [v for _, v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_langid_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    base = d.select("doc_id", "text", d["lang"].alias("declared"), d["source"].alias("host"))
    model = langid.fit(base.where("doc_id % 2 = 0"))
    blind = base.where("doc_id % 2 = 1").drop("declared")
    got = {r["doc_id"]: r for r in langid.identify(blind, model=model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.where("doc_id % 2 = 1").collect()}
    assert sum(got[k]["lang"] == v for k, v in truth.items()) >= 0.97 * len(truth)
    kept = langid.keep_identified(d, "lang", "source")
    assert kept.columns == d.columns and kept.count() >= 0.97 * d.count()


def test_langid_edges(spark, docs):
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text", "lang").withColumnRenamed("lang", "declared")).collect()}
    assert [got[i]["lang"] for i in (0, 1, 2)] == ["und"] * 3 and not any(got[i]["kept"] for i in (0, 1, 2))
    assert langid.identify(docs.select("doc_id", "text")).where("kept").count() == 0  # nothing declared, nothing learned
    assert langid.keep_identified(spark.createDataFrame([], DOCS), "lang", "source").count() == 0


def test_url_rules_and_reputation(spark):
    from pyspark.sql import functions as F

    urls = {1: "https://WWW.Example.com/en/x?q", 2: "http://a.example.com/en/", 3: "http://a.example.com/fr", 4: "no scheme", 5: None, 6: "http://x.net/es/1#t", 7: "http://com", 8: "ftp://notcom/x", 9: "http://h.org:80?x", 10: "http://bad.org/1"}
    pages = [(k, u, k) for k, u in urls.items()] + [(100 + i, f"http://bad.org/{i}", 100 + i) for i in range(60)] + [(200 + i, f"http://good.org/{i}", 200 + i) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, outcome_key long")
    out = spark.createDataFrame([(100 + i, i % 10 != 0) for i in range(60)] + [(200 + i, False) for i in range(60)] + [(100, None), (None, True)], "outcome_key long, bad boolean")
    got = {r["page_id"]: r for r in url_filters.judge(df, out).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(1, 11)] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("a.example.com", "/fr", "com/"), ("", "", None), ("", "", None),
        ("x.net", "/es/1", "net/es/"), ("com", "", None), ("notcom", "/x", None), ("h.org:80", "", None), ("bad.org", "/1", None),
    ]
    assert [got[k]["verdict"] for k in (1, 2, 3, 6, 10, 101, 201)] == ["allow", "block", "allow", "block", "block", "block", "allow"]
    assert {r["verdict"] for r in url_filters.judge(df, out.where(F.lit(False))).where("rule IS NULL").collect()} == {"allow"}
    assert url_filters.judge(df.where("page_id < 0"), out).count() == 0
    s, d = url_filters.suffix_and_domain(F.col("h"))
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.example.com",), ("com",), ("1.2.3.4",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(s, d).collect()] == [("co.uk", "b.co.uk"), ("com", "example.com"), ("com", "com"), ("", "1.2.3.4"), ("", "")]


def test_langid_fusion_in_numpy(spark):
    """Every posterior from the model's weights and plain counts; declarations by primary subtag; names clash."""
    words_of = {"en": "the house and the river are old", "fr": "la maison et la riviere sont vieilles", "de": "das haus und der fluss sind alt"}
    said = {"en": ["en", "EN", "en-US", None], "fr": ["fr", "fr_CA", "junk value", "de"], "de": ["de", " de ", "", None]}
    rows = [(i, f"{words_of[k]} {i}" if i % 11 else None, said[k][i // 3 % 4], f"h{i % 5}.x{i % 2}.org", ("de", "fr", "zz")[i % 3]) for i in range(90) for k in [("en", "fr", "de")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    model = langid.fit(df)
    assert model["languages"] == ["de", "en", "fr"]
    langs, classes = model["languages"], [*model["languages"], "other"]

    def tag(x):
        m = (x or "").strip().lower().replace("_", "-").split("-")[0]
        return m if 2 <= len(m) <= 3 and m.isalpha() else None

    tags = [tag(r[2]) for r in rows]
    domain = lambda h: ".".join(h.split(".")[-2:])
    count = lambda keep: np.array([sum(t == lang for t, r in zip(tags, rows) if keep(r)) for lang in langs], float)
    smooth = lambda own, base: (own + langid.HOST_STRENGTH * base) / (own.sum() + langid.HOST_STRENGTH)
    overall = (count(lambda r: True) + 1) / (count(lambda r: True) + 1).sum()
    got = {r["doc_id"]: r for r in langid.identify(df, model=model).collect()}
    for i, r in enumerate(rows):
        t = langid.trigrams(r[1] or "")
        if not len(t):
            assert (got[i]["lang"], got[i]["kept"]) == ("und", False)
            continue
        joint = model["weights"][t].sum(0, dtype=np.float64) / len(t) * langid.TEMPER * min(len(t), langid.MOST_TRIGRAMS)
        own = np.array([tags[i] == lang for lang in langs], float)
        prior = smooth(np.maximum(count(lambda x: x[3] == r[3]) - own, 0), smooth(count(lambda x: domain(x[3]) == domain(r[3])), overall))
        joint[:-1] += np.log(np.maximum(prior, 1e-6))
        joint[-1] -= np.log(len(classes))
        for vote, trust in ((tags[i], langid.DECLARED_TRUST), (langid.SUFFIX_LANGUAGES.get(r[4]), langid.SUFFIX_TRUST)):
            if vote in langs:
                joint += np.log([trust if c == vote else (1 - trust) / (len(classes) - 1) for c in classes])
        p = np.exp(joint - joint.max())
        p /= p.sum()
        assert got[i]["lang"] == classes[int(p.argmax())] and got[i]["posterior"] == pytest.approx(p.max(), abs=1e-4)
    clash = df.withColumnsRenamed({"suffix": "said", "host": "lang"}).withColumns({"text_ll": df["doc_id"], "kept": df["doc_id"]})
    kept = langid.keep_identified(clash, "declared", "lang")
    assert kept.columns == clash.columns and kept.count() > 60


def test_langid_pages(spark, sf):
    got = registry.langid_pages(spark, sf).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r["page_id"] for r in got) == sorted(pages) and sum(r["kept"] for r in got) >= 0.9 * len(pages)


def test_mixing_repeated_ids_and_clashes(spark):
    """Rows of one id keep their own texts; names that the operator uses are kept; draws against plain sums."""
    rows = [(None if i % 3 == 0 else i % 40, f"{'w ' * (i % 7)}t{i}", "s" if i % 2 else None, i, i, i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words int, _words int, size int, copies int")
    got = mixing.mix(df, block_docs=16).collect()
    out = mixing.repeat(df, block_docs=16)
    assert out.columns == df.columns and len(got) == len(rows)
    back = collections.Counter(tuple(r) for r in out.collect())
    assert set(back) <= set(rows) and max(back.values()) <= 3
    want, have = collections.Counter(), collections.Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r, n in back.items():
        have[r[0], r[2], len(r[1].split())] += n
    assert have == +want
    # a source takes whole passes and, of one pass more, as many words as fill its quota to less than a block's largest document
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        short = own[0]["target"] - sum(r["taken"] for r in own)
        assert -1 <= short <= max(r["size"] for r in own) and len({r["copies"] for r in own}) <= 2


def test_large_draws(spark):
    q = spark.createDataFrame([(1, 3_000_000), (2, 1_000_000), (3, 7)], "rank int, units long")
    got = collections.defaultdict(list)
    for r in mixing.split_quotas(q, 8).collect():
        got[r["rank"]].append(r["units"])
    assert {k: sum(v) for k, v in got.items()} == {1: 3_000_000, 2: 1_000_000, 3: 7}
    assert all(abs(x - 375_000) < 8 * 375_000**0.5 for x in got[1])


def test_ann_ties_lengths_and_doubles(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base * (2.0 ** (i % 50) if i % 2 else 1e200)).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(9)]
    rows += [(2000 + i, (base + 0.01 * rng.normal(size=8)).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id").isin(0, 50, 1000)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [v for v, _ in got[1000]] and all(1000 < v < 1009 + 1 for v, _ in got[1000]) and len(got[1000]) == 5
    same = ann.cosine(np.tile(base * 1e200, (300, 1)), np.array([r[1] for r in rows[:300]]))
    want = sorted((-s, i) for i, s in enumerate(same) if i != 0)[:5]
    assert [v for v, _ in got[0]] == [i for _, i in want] and all(s == pytest.approx(1.0) for _, s in got[0])


def test_media_long_text(spark):
    import tracemalloc

    image = np.random.default_rng(3).integers(0, 256, (400_000, 24)).astype(np.uint8)
    tracemalloc.start()
    small = media.area_resize(image, 9, 8)
    assert tracemalloc.get_traced_memory()[1] < image.nbytes
    tracemalloc.stop()
    assert small.mean() == pytest.approx(image.mean())
