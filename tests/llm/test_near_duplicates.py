"""Near-duplicates of the pipeline: recall of the candidates and what is kept, against all pairs."""

import numpy as np
import pytest

from tracewell.llm import simhash
from tracewell.llm.common import words


def shingles(w, k=5):
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


EDITS = {
    "tail added": lambda w, m, rng: w + new(m, rng),
    "tail cut": lambda w, m, rng: w[: len(w) - m],
    "head added": lambda w, m, rng: new(m, rng) + w,
    "passage exchanged": lambda w, m, rng: w[: len(w) // 2] + new(m, rng) + w[len(w) // 2 + m :],
    "last word changed": lambda w, m, rng: w[:-1] + new(1, rng),
}


def new(m, rng):
    return [f"n{x}" for x in rng.integers(0, 1 << 40, m)]


def furthest(w, edit, rng):
    """The largest edit that stays at 0.8 or more."""
    best = None
    for m in range(1, len(w) // 4 + 2):
        other = edit(w, m, rng)
        if jaccard(w, other) < 0.8:
            break
        best = other
    return best


@pytest.mark.parametrize("kind", EDITS)
@pytest.mark.parametrize("length", [13, 20, 100, 1000])
def test_candidates_by_kind_of_edit(kind, length):
    """The worst edits at 0.8: all are candidates (a miss has a probability of 3.2e-6 a pair)."""
    rng = np.random.default_rng(length)
    found = pairs = 0
    for _ in range(40 if length < 1000 else 8):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, length)]
        if (other := furthest(w, EDITS[kind], rng)) is None:
            continue
        a, b = simhash.bands([simhash._shingle_hashes(words(" ".join(t)), 5) for t in (w, other)])
        found, pairs = found + bool((a == b).any()), pairs + 1
    assert found == pairs


def kept_by_all_pairs(texts, similar=0.8):
    sets = [shingles(words(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def template_texts(rng, groups=3, copies=24):
    """A template under 0.8 to all its copies, which are groups of near copies among themselves."""
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
    texts = [" ".join(base)]
    for g in range(groups):
        w = list(base)
        for at in range(10 * g + 2, 200, 32):
            w[at] = f"g{g}x{at}"
        for c in range(copies):
            texts.append(" ".join(w + [f"c{g}x{c}"]))
    return texts


def test_large_cells_are_searched_by_similarity(spark):
    """Hubs under 0.8 to the rest do not take the links among the rest away."""
    texts = template_texts(np.random.default_rng(1))
    sets = [simhash._shingle_hashes(words(t), 5) for t in texts]
    most = max(max(np.unique(c, return_counts=True)[1]) for c in simhash.bands(sets).T)
    assert most > simhash.SHORT
    want = kept_by_all_pairs(texts)
    assert len(want) == 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want


@pytest.mark.parametrize("chunk", [1 << 19, 1500])
def test_forest_without_hubs(spark, chunk):
    """All links come from the forest; a cell cut into pairs of chunks connects the same."""
    texts = template_texts(np.random.default_rng(2))
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    cells = spark.createDataFrame([(i, 0, 7, i) for i in range(len(texts))], "node long, band int, value long, root long")
    sets = simhash.shingle_sets(docs)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_forest(cells, sets, 0.8, chunk)).collect()}
    assert sorted({roots.get(i, i) for i in range(len(texts))}) == kept_by_all_pairs(texts)


def test_orders_of_the_same_words(spark):
    """Many texts of the same distinct words, near copies only within their group."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(3):
        w = [f"w{x}" for x in rng.permutation(100)]
        texts += [" ".join(w[:at] + [w[at + 1], w[at]] + w[at + 2 :]) for at in (0, 95, 1, 96, 2, 97, 3, 0, 1, 2, 95, 96, 97)] + [" ".join(w + [w[c]]) for c in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == kept_by_all_pairs(texts) == [0, 33, 66]


def test_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts; one row a component stays."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 40))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(None, a), (None, b), (None, near(b)), (None, a.upper()), (7, c), (7, d), (7, near(c)), (7, c), (3, near(d)), (None, near(e)), (5, e), (None, None), (None, ""), (9, " ")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by_group = {g: [k for k in kept if k[1] and g.lower() in k[1].lower()] for g in (a, b, c, d, e)}
    assert all(len(v) == 1 for v in by_group.values()) and len(kept) == 6
    assert [by_group[g][0][0] for g in (a, b, c, d, e)] == [None, None, 7, 3, 5] and (9, " ") in kept


def test_clashing_columns(spark):
    """Columns named like the operator's own, and one that cannot be hashed, come back unchanged."""
    names = ["same", "_same", "_nth", "first_doc", "key", "root", "node"]
    rows = [(i, f"text number {i} of a few words " * 3, {"a": i}, *[99] * len(names)) for i in range(6)] + [(9, "text number 1 of a few words " * 3, {"a": 0}, *[99] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, " + ", ".join(f"`{n}` int" for n in names))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=lambda r: r[0]) == rows[:6]


def test_cells_of_a_fingerprint_by_corpus():
    """70 up to 10^9 fingerprints; finer beyond, so that those met in a cell stay few beside the corpus."""
    rows = lambda n: simhash.comb(simhash.RADIUS + simhash.width(n), simhash.RADIUS)
    assert {rows(10**i) for i in range(1, 10)} == {70}
    chosen = [simhash.width(10**i) for i in range(1, 13)]
    assert chosen == sorted(chosen) and rows(5 * 10**10) <= 210
    for n in (10**10, 5 * 10**10, 10**12):
        assert rows(n) * n * 2 ** (-45 * simhash.width(n) / (simhash.RADIUS + simhash.width(n))) < 2 * 10**-6 * n + 10**5


def test_candidates_of_fingerprints(spark):
    """The stage's candidates are the links of op9's operator over its nodes' fingerprints; its tables are not broadcast."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    texts = [" ".join(base), *(" ".join([*base[:-1], f"x{i}"]) for i in range(4)), " ".join(f"y{x}" for x in rng.integers(0, 1 << 40, 50))]
    nodes = {r["doc_id"]: r["fp"] for r in simhash.near_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: v % (1 << 64) for k, v in nodes.items()} == {i: simhash.fingerprint(t, 5) for i, t in enumerate(texts)}
    links = simhash.fingerprint_links(spark.createDataFrame(list(nodes.items()), "node long, fp long"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    near = lambda a, b: bin((nodes[a] ^ nodes[b]) % (1 << 64)).count("1") <= simhash.RADIUS
    got = {tuple(sorted(r)) for r in links.collect()}
    assert got and all(near(a, b) for a, b in got)
    root = {i: i for i in nodes}
    for a, b in got:
        root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    assert all(root[a] == root[b] for a in nodes for b in nodes if near(a, b))


def test_wide_rows_are_written_in_small_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from tracewell.llm import common

    rows = spark.createDataFrame([(i, np.random.default_rng(i).bytes(1 << 21)) for i in range(24)], "id int, b binary").coalesce(1)
    path = common._paths[common.materialize(rows, "wide", wide=True)]
    files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 1
