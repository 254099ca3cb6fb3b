import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.regexes import glob_to_java, re2_to_java
from tracewell.policy import columns, model, session


def evaluated(spark, spec, calls):
    p = model.load(spec)
    rows = [(i, c.get("tool", "t__x"), c.get("upstream", "t"), c.get("tool_name", c.get("tool", "t__x").split("__")[-1]), json.dumps(c.get("args", {})), c.get("ts"), c.get("labels"), c.get("called"), c.get("calls"), c.get("read_only"), c.get("destructive")) for i, c in enumerate(calls)]
    df = spark.createDataFrame(rows, "i int, tool string, upstream string, tool_name string, args_json string, ts_ms long, session_labels array<string>, session_called array<string>, session_calls long, read_only boolean, destructive boolean")
    return [(r["action"], r["rule_id"]) for r in columns.evaluate(df, p).orderBy("i").select("verdict.*").collect()]


@pytest.mark.parametrize(
    ("path", "matcher", "args", "hit"),
    [
        ("args.mode", {"equals": "live"}, {"mode": "live"}, True),
        ("args.n", {"equals": 5}, {"n": 5.0}, True),
        ("args.n", {"equals": 5}, {"n": "5"}, False),
        ("args.n", {"equals": True}, {"n": 1}, False),
        ("args.mode", {"not_equals": "dry"}, {"mode": "x"}, True),
        ("args.mode", {"not_equals": "dry"}, {}, False),  # missing makes even the negative false
        ("args.cmd", {"regex": r"rm\s+-rf"}, {"cmd": "sudo rm  -rf /"}, True),
        ("args.cmd", {"regex": r"\bfoo"}, {"cmd": "éfoo"}, True),  # an ASCII word boundary
        ("args.cmd", {"shell_regex": r"rm -rf /"}, {"cmd": "r\\m${IFS}-r'f'  /"}, True),
        ("args.sql", {"sql_regex": r"(?i)drop table"}, {"sql": "DROP /* x */ -- y\n table t"}, True),
        ("args.sql", {"not_sql_regex": r"(?i)\bwhere\b"}, {"sql": "delete from t -- where"}, True),
        ("args.path", {"prefix": "/etc/"}, {"path": "/etc/passwd"}, True),
        ("args.path", {"path_prefix": "/srv/app/"}, {"path": "/srv/app/x/../../other"}, False),
        ("args.path", {"path_prefix": "/srv/app/"}, {"path": "/srv/./app"}, True),
        ("args.path", {"not_path_prefix": "/srv/app"}, {"path": "/srv/app-evil/x"}, True),
        ("args.env", {"in": ["prod", 3]}, {"env": 3}, True),
        ("args.amount", {"gt": 10, "lt": 20}, {"amount": 15}, True),
        ("args.amount", {"gt": 10}, {"amount": "15"}, False),
        ("args.force", {"exists": False}, {}, True),
        ("args.items[*].sku", {"prefix": "BAD"}, {"items": [{"sku": "ok"}, {"sku": "BAD1"}]}, True),
        ("args.items[-1]", {"equals": "z"}, {"items": ["a", "z"]}, True),
        ("args.{a,b}", {"equals": 1}, {"b": 1}, True),
        ("args.tags", {"includes": "x"}, {"tags": ["y", "x"]}, True),
        ("args.tags", {"excludes": "x"}, {}, True),
        ("args.o", {"equals": {"a": [1, 2]}}, {"o": {"a": [1, 2]}}, True),
    ],
)
def test_matchers(spark, path, matcher, args, hit):
    got = evaluated(spark, {"rules": [{"id": "r", "tool": "*", "when": {path: matcher}, "action": "deny"}]}, [{"args": args}])
    assert got == [("deny", "r") if hit else ("allow", "")]


def test_order_of_decisions(spark):
    spec = {"budget": {"calls_per_session": 3, "calls_per_tool": {"t.x": 2}}, "packs": ["baseline", {"name": "filesystem", "with": {"workspace": "/w/"}}], "rules": [{"id": "mine", "tool": "t.y", "action": "ask"}]}
    calls = [
        {"tool": "t__y"}, {"args": {"command": "rm -rf /"}}, {"args": {"command": "ls"}}, {"calls": 3, "tool": "t__y"},
        {"tool": "t__write_file", "args": {"path": "/etc/hosts"}}, {"tool": "t__write_file", "args": {"path": "/w/a"}}, {"args": {"sql": "DELETE FROM t"}},
    ]
    assert evaluated(spark, spec, calls) == [("ask", "mine"), ("deny", "baseline/rm-rf-root"), ("allow", ""), ("deny", "budget"), ("deny", "filesystem/write-outside-workspace"), ("allow", ""), ("deny", "baseline/sql-delete-everything")]


def test_session_conditions(spark):
    spec = {"packs": ["lethal-trifecta"], "rules": [{"id": "tests-first", "tool": "t.deploy", "when": {"session.called": {"excludes": "t.test"}}, "action": "ask"}]}
    calls = [{"tool": "t__send_email"}, {"tool": "t__send_email", "labels": ["untrusted-input"]}, {"tool": "t__send_email", "labels": ["untrusted-input", "private-data"]}, {"tool": "t__deploy"}, {"tool": "t__deploy", "called": ["t.test"]}]
    assert [r for _, r in evaluated(spark, spec, calls)] == ["", "lethal-trifecta/egress-after-untrusted", "lethal-trifecta/trifecta", "tests-first", ""]


def test_errors_are_reported_together():
    bad = {"default": "ask", "rules": [{"id": "a", "action": "deny", "when": {"args.x": {"equals": 1, "prefix": "y"}}}, {"id": "a", "action": "fly"}, {"action": "deny", "when": {"result.text": "x"}}], "packs": ["nope", "filesystem"], "unknown": 1}
    with pytest.raises(model.PolicyError) as e:
        model.load(bad)
    for part in ("default", "exactly one matcher", "used twice", "'fly'", "no id", "only label rules", "nope", "workspace", "unknown key"):
        assert part in str(e.value)


def test_lint():
    p = model.load({"rules": [{"id": "open", "action": "allow", "tool": "*", "when": {"args.c": {"regex": "ls"}}}, {"id": "all", "action": "deny"}, {"id": "late", "action": "deny", "tool": "x.y", "when": {"session.label.nope": True}}]})
    found = {(c, r) for _, c, r in model.lint(p, ["t__x"])}
    assert {("unanchored-allow", "open"), ("unreachable", "late"), ("unknown-label", "late"), ("unknown-tool", "late")} <= found


def replayed(spark, spec, calls):
    rows = [(f"{i:03d}", "s", c.get("at", i * 1000), c["tool"], "t", c["tool"].split("__")[1], json.dumps(c.get("args", {})), json.dumps(c.get("args", {})), c.get("tokens", 1), c.get("was", "allow")) for i, c in enumerate(calls)]
    df = spark.createDataFrame(rows, "id string, session_id string, ts_ms long, tool string, upstream string, tool_name string, args_json string, args_hash string, tokens_est long, decision string")
    return session.replay(df, model.load(spec)).orderBy("id").collect()


def test_replay_feeds_back(spark):
    calls = [{"tool": "t__a", "args": {"i": i}} for i in range(4)] + [{"tool": "t__b"}] * 3
    got = replayed(spark, {"budget": {"calls_per_tool": {"t.a": 2}}, "loop_guard": {"repeats": 2}}, calls)
    assert [(r["action"], r["rule_id"]) for r in got] == [("allow", ""), ("allow", ""), ("deny", "budget"), ("deny", "budget"), ("allow", ""), ("allow", ""), ("deny", "loop-guard")]
    assert [r["session_calls"] for r in got] == [1, 2, 2, 2, 3, 4, 4]
    rate = replayed(spark, {"budget": {"calls_per_minute": 2}}, [{"tool": "t__a", "at": t, "args": {"t": t}} for t in (0, 1, 2, 60_000, 60_001)])
    assert [r["action"] for r in rate] == ["allow", "allow", "deny", "allow", "allow"]


def test_replay_labels_and_asks(spark):
    spec = {"labels": [{"label": "read", "tool": "t.read"}], "rules": [{"id": "no-send", "tool": "t.send", "when": {"session.label.read": True}, "action": "deny"}, {"id": "ask", "tool": "t.read", "action": "ask"}]}
    for was, want in (("allow", "deny"), ("deny", "allow")):
        got = replayed(spark, spec, [{"tool": "t__read", "was": was}, {"tool": "t__send"}])
        assert got[1]["action"] == want and got[1]["labels"] == (["read"] if was == "allow" else [])


def test_fold_equals_windows_without_budgets(spark, sf):
    from tracewell.plans.policy_queries import calls_of
    from tracewell.operators import ordered

    c = calls_of(spark, sf).withColumn("decision", F.lit("allow")).withColumn("shadow", F.lit(False))
    folded = session.replay(c, model.load({"budget": {"calls_per_session": 10**9}})).select("id", (F.col("session_calls") - 1).alias("n"))
    assert folded.join(ordered.running_counters(c), "id").where("n <> session_calls").count() == 0


@pytest.mark.parametrize(("a", "b"), [("abcde", "abxde"), ("", "ab"), ("abc", ""), ("same", "same"), ("aXbXc", "XaXbc")])
def test_alignment(a, b):
    pairs = session.align(list(a), list(b))
    assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
    assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [(r"\bfoo", "éfoo", True), (r"a$", "a\n", False), (r"a.b", "a\rb", True), (r"a\sb", "a\x0bb", False), ("(?i)k", "K", True), ("(?i)É", "é", True), (r"[\s]x", "\x0bx", False), (r"(?m)a$", "a\nb", True), (r"[a[]", "[", True)],
)
def test_dialect(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(re2_to_java(pattern)).alias("h")).first()["h"] is hit


def test_globs(spark):
    df = spark.createDataFrame([("fs__read",), ("fs.read",), ("x",)], "t string")
    assert [r["h"] for r in df.select(F.col("t").rlike(glob_to_java("fs.*|x")).alias("h")).collect()] == [False, True, True]
