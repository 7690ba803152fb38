"""Rule packs, the taxonomy, and the versioned tables of the import."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from tallyloom.operators import pack, taxonomy
from tallyloom.sources import store

RULE = {"id": "own/x", "match": {"program": ["x"], "argv_prefix": ["run"]}, "action": "passthrough"}


def write(folder, files, **more):
    folder.mkdir()
    for i, r in enumerate(files):
        (folder / f"{i}.json").write_text(r if isinstance(r, str) else json.dumps(r))
    (folder / "pack.json").write_text(json.dumps({"schema_version": 1, "id": "own", "rules": [f"{i}.json" for i in range(len(files))]} | more))
    return str(folder)


def test_pack(spark, tmp_path):
    name, rules, digest = pack.load(write(tmp_path / "a", [RULE, RULE | {"id": "own/a"}]))
    assert (name, [r["id"] for r in rules], len(digest)) == ("own", ["own/a", "own/x"], 64)
    table = pack.compiled(spark, name, rules)
    assert pack.damaged(table).count() == 0 and pack.program_index(table).collect()[0]["rule_ids"] == ["own/a", "own/x"]
    both = table.unionByName(pack.compiled(spark, "other", [RULE]))
    assert [r["rule_id"] for r in pack.usable(both).collect()] == ["own/a"]
    bad = [RULE | {"x": 1}, RULE | {"id": "Bad Id"}, RULE | {"action": "reduce"}, RULE | {"match": {"program": []}}, '{"id":"a","id":"b"}']
    for i, r in enumerate(bad):
        with pytest.raises(pack.PackError):
            pack.load(write(tmp_path / f"b{i}", [r]))
    with pytest.raises(pack.PackError):
        pack.load(write(tmp_path / "c", [RULE], rules=["../a/0.json"]))


def test_lint(spark):
    shape = "rule_id string, program string, action string, prefix array<string>"
    rows = [("a", "x", "reduce", ["p"]), ("b", "x", "reduce", ["p", "q"]), ("c", "x", "reduce", ["q"]), ("d", "y", "reduce", ["p"]), ("e", "x", "passthrough", []), ("f", "y", "transform", []), ("f", "x", "transform", ["q", "r"])]
    assert {tuple(r) for r in pack.overlaps(spark.createDataFrame(rows, shape)).collect()} == {("a", "b"), ("c", "f"), ("d", "f")}
    limits = spark.createDataFrame([(16384, 32768, 704, 704, 0), (10, 5, 1000, 704, 7)], "line_bytes long, failure_line_bytes long, output_bytes long, failure_output_bytes long, pattern_bytes long")
    assert [r[0] for r in limits.select(pack.memory_bound(limits)).collect()] == [704 + 7040 + 12 * 32768 + 336512, 1000 + 8520 + 120 + 7 + 336512]


CASES = [
    ("ls -la", "filesystem/ls"), ("docker -H h logs x", "container/logs"), ("kubectl -n a get pods", "cluster/inspection"), ("git -C d reflog", "git/reflog"), ("git", "git/no-subcommand"),
    ("pnpm run lint", "package/pnpm-lint-task"), ("npm install x", "package/mutation"), ("cargo fmt", "developer/cargo-other"), ("/usr/bin/python x.py", "script/other"), ("./script", "command/other"), ("nothing", "command/other"),
]


def test_taxonomy(spark):
    rows = []
    for c, want in CASES:
        argv = c.split()
        assert taxonomy.assess(argv)[0] == want
        program = argv[0].rpartition("/")[2]
        rows.append((c, program, taxonomy.subcommand([program, *argv[1:]])))
    got = taxonomy.families(spark, spark.createDataFrame(rows, "command string, program string, sub string")).collect()
    assert {r["command"]: r["family"] for r in got} == dict(CASES)
    assert taxonomy.assess(None)[1] == "required_pass_through" and taxonomy.assess([])[0] == "shell/setup-or-wrapper"


def test_store(spark, tmp_path):
    base, cols = str(tmp_path / "t"), "call_key string, n long"
    df = lambda *r: spark.createDataFrame(list(r), cols)
    assert store.read(spark, base, "tool_calls") is None
    store.publish(spark, base, 1, {"tool_calls": store.merged(None, df(("a", 2), ("a", 1)), "call_key", ("n",))})
    store.publish(spark, base, 2, {"tool_calls": store.merged(store.read(spark, base, "tool_calls"), df(("a", 0), ("b", 5)), "call_key", ("n",))})
    assert {tuple(r) for r in store.read(spark, base, "tool_calls").collect()} == {("a", 1), ("b", 5)}
    with pytest.raises(ValueError):
        store.publish(spark, base, 2, {"tool_calls": df(("z", 0))})
    assert store.read(spark, base, "tool_calls").count() == 2
    assert {tuple(r) for r in store.upserted(df(("a", 1), ("b", 2)), df(("b", 9)), "call_key").collect()} == {("a", 1), ("b", 9)}
    obs = spark.createDataFrame([("s", "a", None), ("s", None, "r1"), ("t", None, "r2"), ("s", "b", None), ("t", "b", None)], "source_item_key string, call_key string, result_key string")
    results = spark.createDataFrame([("r1", "a"), ("r2", "c")], "result_key string, call_key string")
    o, r, c = store.without_source(obs, results, df(("a", 1), ("b", 1), ("c", 1)), "s")
    assert (o.count(), [x["result_key"] for x in r.collect()], {x["call_key"] for x in c.collect()}) == (2, ["r2"], {"b", "c"})
    t = spark.createDataFrame([("s", 1, 0, "x", "1"), ("s", 2, 0, "y", "2")], "session_id string, line_no long, item long, tool_name string, input_text string")
    u = spark.createDataFrame([("s", 5, 0, "x", "1"), ("s", 6, 0, "y", "3"), ("s", 7, 0, "z", "")], t.schema)
    assert [x["verdict"] for x in store.transcript_check(t, u).orderBy("place").collect()] == ["validated", "mismatch", "count"]


def test_commits(spark, tmp_path):
    """Writers at once, one that dies, a reader in between: every change is in, once."""
    base, cols = str(tmp_path / "t"), "call_key string, n long"
    df = lambda *r: spark.createDataFrame(list(r), cols)
    more = lambda k, n: lambda old: {"tool_calls": store.merged(old("tool_calls"), df((k, n)), "call_key", ("n",))}
    assert store.commit(spark, base, more("a", 1)) == 1
    with ThreadPoolExecutor(3) as pool:
        versions = sorted(pool.map(lambda k: store.commit(spark, base, more(k, 2)), "bcd"))
    assert versions == [2, 3, 4] and {tuple(r) for r in store.read(spark, base, "tool_calls").collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 2)}

    before = store.read(spark, base, "tool_calls")  # goes on seeing what it began with

    def dies(old):
        df(("x", 0)).write.parquet(f"{base}/tool_calls/version=5-dead")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.commit(spark, base, dies)
    assert store.commit(spark, base, more("e", 3)) == 5 and before.count() == 4 and store.read(spark, base, "tool_calls").count() == 5
    seen = []

    def slow(old):
        if not seen:  # another run comes first
            seen.append(store.commit(spark, base, more("f", 4)))
        return more("g", 5)(old)

    assert store.commit(spark, base, slow) == 7 and store.read(spark, base, "tool_calls").count() == 7
    with pytest.raises(store.Conflict):
        store.commit(spark, base, lambda old: seen.append(store.commit(spark, base, more(f"h{len(seen)}", 0))) or more("i", 0)(old), tries=2)
    store.commit(spark, base, lambda old: {"sessions": df(("s", 1))})
    assert store.read(spark, base, "tool_calls").count() == 9 and store.read(spark, base, "sessions").count() == 1
    assert store.swept(spark, base) > 3 and store.read(spark, base, "tool_calls").count() == 9
