import hashlib

from tracewell.detect import skills


def test_skill_folders(spark, tmp_path):
    for name, data in {"a b/SKILL.md": b"one\r\ntwo\n", "a b/bin/x+y%20z.sh": b"echo", "c/raw": b"\x00\r\n\xff", "loose.md": b"no skill's"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = skills.read_skills(spark, str(tmp_path))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {("a b", "SKILL.md", 9, sha(b"one\ntwo\n")), ("a b", "bin/x+y%20z.sh", 4, sha(b"echo")), ("c", "raw", 4, sha(b"\x00\r\n\xff"))}
    assert {(r["skill"], r["path"], r["size"], r["hash"]) for r in got.collect()} == want
    locked = spark.createDataFrame([("a b", "SKILL.md", sha(b"one\ntwo\n")), ("c", "raw", "other"), ("d", "SKILL.md", "x")], "skill string, path string, hash string")
    assert {tuple(r) for r in skills.check_files(got, locked).collect()} == {("a b", "bin/x+y%20z.sh", "added"), ("c", "raw", "changed"), ("d", "SKILL.md", "removed")}
