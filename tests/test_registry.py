import hashlib
import json

import pytest

from tracewell.operators import chain
from tracewell.sources import log


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def plain_root(lines):
    leaves = [hashlib.sha256(b"\x00" + x).digest() for x in lines]

    def root(x):
        if len(x) <= 1:
            return x[0] if x else hashlib.sha256(b"").digest()
        k = 1
        while 2 * k < len(x):
            k *= 2
        return hashlib.sha256(b"\x01" + root(x[:k]) + root(x[k:])).digest()

    return root(leaves).hex()


def registry(tmp_path, publications):
    lines, last = [], {}
    for path, text in publications:
        if last.get(path) != text:
            lines.append(json.dumps({"index": len(lines), "path": path, "server": path, "version": "1", "hash": sha(text), "at": "2024-01-01T00:00:00Z"}).encode())
            last[path] = text
    return lines, [(p, sha(t)) for p, t in last.items()]


def report(spark, tmp_path, lines, files, **options):
    (tmp_path / "log.jsonl").write_bytes(b"".join(x + b"\n" for x in lines))
    read = log.registry_log(spark, str(tmp_path / "log.jsonl"))
    return read, sorted(tuple(r) for r in chain.registry_report(read, spark.createDataFrame(files, "path string, hash string"), **options).collect())


def test_registry_log(spark, tmp_path):
    lines, files = registry(tmp_path, [("notes/1.json", "a"), ("fs/2.json", "b"), ("notes/1.json", "a")])
    assert len(lines) == 2  # publishing the same thing again records nothing
    first = (2, plain_root(lines))
    read, problems = report(spark, tmp_path, lines, files, head=first)
    assert problems == [] and [(r["place"], r["index"], r["path"]) for r in read.orderBy("place").collect()] == [(0, 0, "notes/1.json"), (1, 1, "fs/2.json")]
    assert log.tree_head(f"2:sha256:{first[1]}") == log.tree_head(f" 2:{first[1]}\n") == first
    with pytest.raises(ValueError):
        log.tree_head("two")
    # the same version again with something else in it: recorded, and shown
    lines, files = registry(tmp_path, [("notes/1.json", "a"), ("fs/2.json", "b"), ("notes/1.json", "changed")])
    read, problems = report(spark, tmp_path, lines, files, head=(3, plain_root(lines)), noted=[first])
    assert problems == [] and [tuple(r) for r in chain.rewrites(read).collect()] == [("notes/1.json", 2)]
    # changed without publishing, added by hand, a head that is another's
    _, problems = report(spark, tmp_path, lines, [("notes/1.json", sha("x")), ("fs/2.json", sha("b")), ("sneaky/1.json", sha("{}"))], head=first, noted=[first])
    assert problems == [("2", "head"), ("notes/1.json", "changed"), ("sneaky/1.json", "by-hand")]
    # cut short, or rewritten
    _, problems = report(spark, tmp_path, lines[:1], files, noted=[first])
    assert ("2", "cut") in problems
    _, problems = report(spark, tmp_path, [lines[0].replace(b"notes", "nötes".encode()), *lines[1:]], files, noted=[first, (0, plain_root([]))])
    assert ("2", "rewritten") in problems and ("0", "rewritten") not in problems
    _, problems = report(spark, tmp_path, [lines[0], lines[2], lines[1]], files)
    assert problems == [("1", "moved"), ("2", "moved")]


def test_lines_keep_their_bytes_and_order(spark, tmp_path):
    rows = [json.dumps({"index": i, "path": f"p{i}", "hash": "h" * (i % 50)}).encode() + (b"\r" if i % 3 == 0 else b"") for i in range(3000)]
    rows[7] = b'{"path":"\xff\xfe"}'
    (tmp_path / "log.jsonl").write_bytes(b"\n\n".join(rows) + b"\n \t\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = log.registry_log(spark, str(tmp_path / "log.jsonl")).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["place"] for r in got] == list(range(3000)) and [r["index"] for r in got if r["index"] is not None] == [i for i in range(3000) if i != 7]
    assert [r["leaf"] for r in got] == [hashlib.sha256(b"\x00" + x.rstrip(b"\r")).hexdigest() for x in rows]
    (tmp_path / "none.jsonl").write_bytes(b"")
    assert log.registry_log(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_frontiers_go_on(spark):
    lines = [str(i).encode() for i in range(300)]
    leaves = spark.createDataFrame([(i, hashlib.sha256(b"\x00" + x).hexdigest()) for i, x in enumerate(lines)], "place long, leaf string").cache()
    heads = []
    for size in (0, 1, 3, 8, 100, 101, 256, 300):
        heads = chain.frontier(leaves.where(f"place >= {sum(n for n, _ in heads)}"), size, heads, 4)  # what is before isn't read again
        assert [n for n, _ in heads] == [1 << k for k in range(20, -1, -1) if size >> k & 1] and chain.frontier_root(heads) == plain_root(lines[:size])
    assert chain.frontier(leaves, 301, heads) is None and chain.frontier(leaves, 400) is None
    with pytest.raises(ValueError):
        chain.frontier(leaves, 10, heads)


def test_publications_are_recorded_once(spark):
    known = spark.createDataFrame([(0, "a", "1"), (1, "b", "1"), (2, "a", "2")], "index long, path string, hash string")
    more = spark.createDataFrame([(0, "a", "2"), (1, "a", "1"), (2, "a", "1"), (3, "c", "9"), (70_000, "b", "2"), (70_001, "c", "9")], "n long, path string, hash string")
    got = sorted((r["index"], r["path"], r["hash"]) for r in chain.new_publications(known, more).collect())
    assert got == [(3, "a", "1"), (4, "c", "9"), (5, "b", "2")]
