import os
from datetime import datetime, timedelta

from codeloom import schema
from codeloom.operators import search
from codeloom.sources import files, store
from codeloom.streaming import audit as stream

AT = datetime(2025, 1, 1)


def node(uuid, repo):
    return (uuid, repo, "a.py", "function", "n", 1, 2, None, [], None, "system", AT, False, [])


def log_row(i, at, action="add_node"):
    return (f"i{i}", at, "u", action, "node", f"e{i}", None)


def test_scan(spark, tmp_path):
    for name in ("main.py", "node_modules/x.js", ".git/y.py", "src/test_a.py", "src/app.ts", "src/readme.md", "src/__init__.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 'é'\n", encoding="utf-8")
    rows = files.scan(spark, str(tmp_path), "r").collect()
    assert sorted(r.file_path for r in rows) == ["main.py", "src/app.ts"] and {r.content for r in rows} == {"x = 'é'\n"}
    assert files.prioritised(files.scan(spark, str(tmp_path), "r")).count() == 2
    assert files.settings(30, timeout=7)["timeout"] == 7 and files.is_remote("git@x:y") and not files.is_remote("/tmp/x")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read("nodes").count() == 0 and not s.has_repo("a")
    s.write("nodes", spark.createDataFrame([node("1", "a"), node("2", "b"), node(None, "b")], schema.NODES))
    s.write("nodes", spark.createDataFrame([node("3", "b")], schema.NODES))
    assert {(r.uuid, r.repo_id) for r in s.read("nodes").collect()} == {("1", "a"), ("3", "b")}
    link = lambda i, a, b: (i, a, b, "calls", None, "system", AT, False, [])
    s.write("edges", spark.createDataFrame([link("x", "1", "3"), link("y", "1", "1"), link("z", "3", "9")], schema.EDGES))
    said = lambda i, kind, e: (i, AT, "u", "add_node", kind, e, None)
    s.append("audit", spark.createDataFrame([said("p", "node", "1"), said("q", "node", "3"), said("r", "edge", "x"), said("s", "repo", "b"), said("t", None, None)], schema.AUDIT))
    s.delete_repo("b")
    assert {r.repo_id for r in s.repos().collect()} == {"a"} and s.has_repo("a") and not s.has_repo("b")
    assert [r.uuid for r in s.read("edges").collect()] == ["y"] and sorted(r.uuid for r in s.read("audit").collect()) == ["p", "t"]
    both = store.upserted(s.read("nodes"), spark.createDataFrame([node("1", "c")], schema.NODES), ["uuid"])
    assert [r.repo_id for r in both.collect()] == ["c"]
    index = search.index(s.read("nodes"))
    store.write_index(index, str(tmp_path / "index"))
    assert [r.uuid for r in store.read_index(spark, str(tmp_path / "index")).collect()] == ["1"]
    assert files.load_tags(str(tmp_path / "none.json")) == {"auto_tags": [], "manual_tags": {}}


def test_log_skips_malformed_lines_but_counts_them(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame([log_row(0, AT)], schema.AUDIT).coalesce(1), path)
    with open(os.path.join(path, "zz.json"), "w") as f:
        f.write('{"uuid": "x1", "action": "a"}\nbroken{\n{"uuid": "x2", "timestamp": "2025-01-01T00:00:00.5"}\n')
    everything = store.read_log(spark, path).collect()
    assert {r.uuid for r in everything} == {"i0", "x1", "x2"}
    assert len(store.read_log(spark, path, limit=1).collect()) == 1 and store.read_log(spark, path, offset=99).count() == 0
    assert store.read_log(spark, str(tmp_path / "none")).count() == 0
    assert [r.n for r in everything] == [0, 1, 3] and [r.n for r in store.read_log(spark, path, offset=1).collect()] == [1, 3]


def test_log_in_many_splits(spark, tmp_path):
    path = tmp_path / "big"
    path.mkdir()
    for k in range(3):
        (path / f"p{k}.json").write_text("".join('{"uuid": "u%d"}\n' % (k * 1000 + i) for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = store.read_log(spark, str(path), limit=5000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.n, r.uuid) for r in rows] == [(i, f"u{i}") for i in range(3000)]


def test_clone(spark, tmp_path):
    import subprocess

    import pytest

    origin = tmp_path / "origin"
    origin.mkdir()
    (origin / "main.py").write_text("x = 1\n")
    run = lambda *a: subprocess.run(["git", "-C", str(origin), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("-c", "user.email=a@b.c", "-c", "user.name=n", "commit", "-qm", "m")
    place = files.clone(f"file://{origin}", str(tmp_path / "copy"))
    assert [r.file_path for r in files.scan(spark, place, "r").collect()] == ["main.py"]
    with pytest.raises(RuntimeError):
        files.clone(f"file://{tmp_path}/nowhere", str(tmp_path / "no"))


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [log_row(i, AT + timedelta(hours=i % 40), " ADD_node" if i % 2 else "tag") for i in range(100)] + [log_row(200, None)]
    df = spark.createDataFrame(rows, schema.AUDIT)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream.windowed_counts(stream.read(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in stream.windowed_counts(df).collect()}


def test_deduplicated_stream_and_upsert(spark, tmp_path):
    rows = [log_row(i % 10, AT + timedelta(minutes=i)) for i in range(30)]
    spark.createDataFrame(rows, schema.AUDIT).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = stream.deduplicated(stream.read(spark, str(tmp_path / "in"))).writeStream.foreachBatch(stream.upsert_into(out, ["entity_uuid"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = sorted(int(v[1:]) for v in os.listdir(out))[-1]
    assert spark.read.parquet(f"{out}/v{last}").count() == 10
