import io
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corvine.operators.postings import request_table
from corvine.plans.engine import Engine
from corvine.__main__ import line_request
from corvine.plans.embedders import HashingEmbedder, OnnxEmbedder, embed_texts, mean_pool, unit
from corvine.plans.index import ConcurrentUpdate, Index, counts, parse_files
from corvine.schema import Request
from corvine.sources.scan import read_files, read_tree, walk
from corvine.server import serve
from corvine.streaming.changes import advance, difference, snapshot
from corvine.streaming.updater import apply_batch, follow, with_content

FILES = {
    "src/A.java": "class A { int find() { return 1; } }",
    "src/b.js": "function find() { return 2 }",
    "build/C.java": "class C { }",
    "lib/x.jar": "x",
    "skip/D.java": "class D { }",
    "keep.xml": "<a><b id='q'/></a>",
    "bad.xml": "<a></b>",
    "notes.txt": "x",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "tree" / ".gitignore").write_text("skip/\n")
    return str(tmp_path / "tree")


def names(paths, root):
    return sorted(os.path.relpath(p, os.path.realpath(root)) for p in paths)


def test_walk_and_read_tree_agree(spark, tree):
    assert names(walk(tree), tree) == [".gitignore", "bad.xml", "keep.xml", "notes.txt", "src/A.java", "src/b.js"]
    rows = read_tree(spark, os.path.realpath(tree)).select("path", "ext").collect()
    assert names([r["path"] for r in rows], tree) == ["bad.xml", "keep.xml", "src/A.java", "src/b.js"]
    with pytest.raises(FileNotFoundError):
        walk(tree + "/none")


def test_walk_survives_a_link_to_its_parent(tree):
    os.symlink(tree, f"{tree}/loop")
    assert len(walk(tree)) == 6


def test_counts(spark, tree):
    got = {r["status"]: (r["files"], r["blocks"]) for r in counts(parse_files(read_files(spark, walk(tree)))).collect()}
    assert got == {"parsed": (3, 5), "failed": (3, 0)}


def state(index):
    return sorted(tuple(r) for r in index.blocks().select("file_path", "start_line", "kind", "name", "content").collect())


def test_updates_equal_a_fresh_build(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "i"), HashingEmbedder(16), buckets=3)
    index.build(read_files(spark, walk(tree)))
    assert index.blocks().count() == 5
    assert index.vectors().count() == 3  # a vector a key; a class on one line shares its key with its method
    top = index.engine().search(Request("find", limit=3)).collect()
    assert {r["name"] for r in top} >= {"find"} and "tokens" not in top[0].asDict()
    plain = Engine(index.blocks().drop("tokens")).search(Request("find")).collect()
    assert Engine(index.blocks()).search(Request("find")).collect() == plain
    a, b, xml = (f"{os.path.realpath(tree)}/{n}" for n in ("src/A.java", "src/b.js", "keep.xml"))
    changes = [(a, "upsert", b"class A { void other() { } void more() { } }"), (b, "remove", None), (xml, "upsert", b"</broken>")]
    index.apply(spark.createDataFrame(changes, "path string, op string, content binary"))
    index.apply(spark.createDataFrame(changes, "path string, op string, content binary"))  # again: the same
    with open(a, "wb") as f:
        f.write(changes[0][2])
    os.remove(b)
    fresh = Index(spark, str(tmp_path / "j"), HashingEmbedder(16), buckets=3)
    fresh.build(read_files(spark, walk(tree)))
    assert state(index) == state(fresh)  # a file that no longer parses keeps its old rows
    assert index.vectors().count() == fresh.vectors().count()
    index.apply(spark.createDataFrame([(a, "upsert", b"")], "path string, op string, content binary"))
    assert not index.blocks().where(F.col("file_path") == a).count()
    index.clear()
    assert index.blocks().count() == index.vectors().count() == 0


def test_difference():
    old, new = {"/gone.java": 1, "/same.java": 1, "/other.java": 1}, {"/same.java": 1, "/other.java": 2, "/new.java": 1}
    rows = difference(old, new)
    assert rows == [(0, "/gone.java", "remove"), (1, "/new.java", "upsert"), (2, "/other.java", "upsert")]
    assert advance(old, new, rows) == new
    first = difference(old, new, 2)
    assert first == rows[:2] and difference(advance(old, new, first), new) == [(0, "/other.java", "upsert")]


def test_contents_are_read_by_tasks(spark, tree):
    changes = spark.createDataFrame([(f"{tree}/src/A.java", "upsert"), (f"{tree}/gone.java", "upsert"), (f"{tree}/x.java", "remove")], "path string, op string")
    got = sorted((os.path.basename(r["path"]), r["op"], r["content"] is None) for r in with_content(changes).collect())
    assert got == [("A.java", "upsert", False), ("gone.java", "remove", True), ("x.java", "remove", True)]


def test_writers_do_not_overwrite_each_other(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=2)
    index.build(read_files(spark, walk(tree)))
    one, two = (spark.createDataFrame([("/z/A.java", "upsert", f"class {n} {{ }}".encode())], "path string, op string, content binary") for n in "ZY")
    dealt, other = index._dealt, Index(spark, str(tmp_path / "i"))

    def late(*rows):  # another writer commits between this one's first and last look
        index._dealt = dealt
        other.apply(two)
        return dealt(*rows)

    index._dealt = late
    before = state(index)
    with pytest.raises(ConcurrentUpdate):
        index.apply(one)
    assert [r[3] for r in sorted(set(state(index)) - set(before))] == ["Y"]
    index.apply(one)
    assert [r[3] for r in sorted(set(state(index)) - set(before))] == ["Z"]


def test_commits_of_one_moment(spark, tmp_path):
    """Many writers at once: each number has one winner, who saw all before it; other buckets' commits are kept."""
    from concurrent.futures import ThreadPoolExecutor

    from corvine.plans.snapshots import Log

    root = str(tmp_path)
    first = Log(spark, root).commit(Log(spark, root).newest(), {("t", 99): 1}, 200)

    def write(k):
        try:
            return Log(spark, root).commit(first, {("t", k): k, ("t", 100 + k % 2): k}, 200).number
        except ConcurrentUpdate:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(write, range(12)) if n]
    assert sorted(won) == [2, 3]  # buckets 100 and 101 have one winner each
    end = Log(spark, root).newest()
    assert end.number == 3 and end.versions[("t", 99)] == 1 and {end.versions[("t", b)] % 2 for b in (100, 101)} == {0, 1}
    with ThreadPoolExecutor(8) as pool:
        pool.map(lambda k: Log(spark, root).commit(end, {("u", k): k}, 200), range(12))
    assert {k: v for k, v in Log(spark, root).newest().versions.items() if k[0] == "u"} == {("u", k): k for k in range(12)}
    assert not [p for p in (tmp_path / "log").iterdir() if "draft" in p.name]


def test_writes_report_what_they_did(spark, tree, tmp_path, caplog):
    index = Index(spark, str(tmp_path / "i"), buckets=2)
    assert index.build(read_files(spark, walk(tree))) == {"parsed": 3, "failed": 3, "removed": 0, "blocks": 5}
    rows = [(1, "/a.xml", "upsert", b"<a><b/></a>"), (2, "/b.xml", "upsert", b"</b>"), (3, "/c.xml", "remove", None), (0, "/a.xml", "upsert", b"<old/>")]
    with caplog.at_level("INFO", "corvine.streaming.updater"):
        apply_batch(index)(spark.createDataFrame(rows, LOG), 7)
    assert "batch 7" in caplog.text and "'parsed': 1, 'failed': 1, 'removed': 1, 'blocks': 2" in caplog.text
    assert index.apply(spark.createDataFrame(rows[:1], LOG)) == {"parsed": 0, "failed": 0, "removed": 0, "blocks": 0}  # not newer
    assert index.apply(spark.createDataFrame([], LOG)) == dict.fromkeys(("parsed", "failed", "removed", "blocks"), 0)


def test_vacuum(spark, tmp_path):
    index = Index(spark, str(tmp_path), buckets=1)
    change = lambda n: spark.createDataFrame([("/a.xml", "upsert", f"<n{n}/>".encode())], "path string, op string, content binary")
    index.build(spark.createDataFrame([("/b.xml", b"<b/>")], "path string, content binary"))
    for n in range(3):
        index.apply(change(n))
    held = index.blocks(index.snapshot())
    assert index.vacuum() == [] and index.vacuum(3600) == []
    time.sleep(0.05)
    index.apply(change(3))
    gone = index.vacuum(0.01)
    assert len(gone) == 6 and {g.split("/")[0] for g in gone} == {"blocks", "files"}  # the one before the newest may have readers
    assert sorted(r["name"] for r in held.collect()) == ["b", "n2"]
    assert sorted(r["name"] for r in index.blocks().collect()) == ["b", "n3"] and index.vacuum(0.01) == []


def test_kept_lists_follow_updates(spark, tmp_path):
    """After random updates, searches by the kept lists and sums equal those over the texts and over a new index."""
    rng = random.Random(4)
    names = ["find", "User", "findUser", "load", "x"]
    java = lambda: "class %s { int %s() { return %s; } }" % tuple(rng.choice(names) for _ in range(3))
    now = {f"/p/{i}.java": java() for i in range(12)}
    index = Index(spark, str(tmp_path / "i"), HashingEmbedder(8), buckets=3, postings=True)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    index.build(frame([(p, t.encode()) for p, t in now.items()], "path string, content binary"))
    for _ in range(3):
        changes = []
        for p in rng.sample([f"/p/{i}.java" for i in range(15)], 4):
            gone = rng.random() < 0.4
            text = None if gone else java()
            changes.append((p, "remove" if gone else "upsert", None if gone else text.encode()))
            now.pop(p, None) if gone else now.update({p: text})
        index.apply(frame(changes, "path string, op string, content binary"))
    fresh = Index(spark, str(tmp_path / "j"), buckets=2, postings=True)
    fresh.build(frame([(p, t.encode()) for p, t in now.items()], "path string, content binary"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    for table in ("by_file", "grams"):
        assert rows(getattr(index.lists(), table).distinct(), "*") == rows(getattr(fresh.lists(), table).distinct(), "*")
    engine, plain = index.engine(), Engine(index.blocks(), index.vectors(), index.engine().embed)
    asked = [Request("find user"), Request("x", path="/p/1", limit=4), Request("User", lang="java,xml"), Request("find", lang="xml"), Request("ser")]
    for r in asked[:3]:
        assert engine.search(r).collect() == plain.search(r).collect()
        assert Engine(index.blocks(), lists=index.lists()).search(r, "inner").collect() == Engine(index.blocks()).search(r, "inner").collect()
    own = ("request", "ordinal", "file_path", "name", "score")
    assert rows(engine.search_many(asked), *own) == rows(plain.search_many(asked), *own)
    words = rows(Engine(index.blocks(), lists=index.lists()).search_many(asked), *own)
    assert words == rows(Engine(index.blocks()).search_many(asked), *own) and {r[0] for r in words} == {0, 1, 2}
    plan = index.lists().scores(request_table(spark, [Request("find")]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "In(term" in plan or "EqualTo(term" in plan


def test_lists_belong_to_the_index(spark, tmp_path):
    """Whoever writes: an index that was built with lists keeps them, one that was not does without."""
    rows = lambda *names: spark.createDataFrame([(f"/{n}.xml", "upsert", f"<{n}/>".encode()) for n in names], "path string, op string, content binary")
    for built, others in ((True, False), (False, True)):
        root = f"{tmp_path}/{built}"
        Index(spark, root, buckets=2, postings=built).build(rows("a", "b").drop("op"))
        index = Index(spark, root, postings=others)
        index.apply(rows("c", "d"))
        assert (index.engine().lists is not None) == built
        assert [r["name"] for r in index.engine().search(Request("c")).collect()] == ["c"]


LOG = "seq bigint, path string, op string, content binary"


def test_changes_keep_their_order_over_batches(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), HashingEmbedder(8), buckets=2)
    index.build(spark.createDataFrame([("/old.xml", b"<o/>")], "path string, content binary"))
    run = apply_batch(index)
    batch = lambda *rows: run(spark.createDataFrame(list(rows), LOG), 0)
    shown = lambda: sorted((r["file_path"], r["name"]) for r in index.blocks().collect())
    batch((10, "/a.xml", "upsert", b"<new/>"), (4, "/old.xml", "remove", None))
    batch((5, "/a.xml", "upsert", b"<older/>"), (3, "/old.xml", "upsert", b"<revived/>"), (1, "/b.xml", "upsert", b"<b/>"))
    assert shown() == [("/a.xml", "new"), ("/b.xml", "b")]
    batch((12, "/a.xml", "upsert", b"</broken>"), (2, "/b.xml", "remove", None))
    batch((11, "/a.xml", "upsert", b"<late/>"), (2, "/b.xml", "remove", None))  # broken at 12: what was there stays
    assert shown() == [("/a.xml", "new")]
    assert {(r["path"], r["error"] is None, int(r["seq"])) for r in index.files().collect()} == {("/a.xml", False, 12)}
    batch((13, "/a.xml", "remove", None), (5, "/old.xml", "upsert", b"<back/>"))
    batch((12, "/a.xml", "upsert", b"<again/>"))
    assert shown() == [("/old.xml", "back")] and index.vectors().count() == 1
    # changes without a place are taken as they come, and the place of the path stays
    index.apply(spark.createDataFrame([("/old.xml", "upsert", b"<free/>"), ("/x.xml", "upsert", b"<x/>")], "path string, op string, content binary"))
    batch((5, "/old.xml", "upsert", b"<no/>"), (1, "/x.xml", "upsert", b"<y/>"))
    assert shown() == [("/old.xml", "free"), ("/x.xml", "y")]


def test_a_log_in_many_batches_in_any_order(spark, data, tmp_path):
    from corvine.plans import catalogue

    events = spark.read.parquet(f"{data}/events.parquet")
    whole = sorted(map(tuple, catalogue.upsert_apply(spark, data).collect()))
    events.repartition(8, "event_id").write.parquet(str(tmp_path / "log"))
    index = Index(spark, str(tmp_path / "i"), buckets=2)
    body = apply_batch(index)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    batches = []

    def run(batch, n):
        batches.append(n)
        body(catalogue.as_changes(batch), n)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 8 and sorted(map(tuple, catalogue.users(index).collect())) == whole


def test_a_restart_keeps_the_index(spark, tree, tmp_path, monkeypatch, capsys):
    from corvine import __main__ as cli

    def session(*lines):
        monkeypatch.setattr("sys.stdin", io.StringIO("".join(f"{x}\n" for x in lines)))
        assert cli.main(["--path", tree, "--index", str(tmp_path / "i"), "--no-embedding"]) == 0
        return capsys.readouterr().out

    assert "Name: find" in session("find")
    assert "Name: find" in session("find")
    os.remove(f"{tree}/src/b.js")
    with open(f"{tree}/src/New.java", "w") as f:
        f.write("class Fresh { }")
    out = session("Fresh", "find")
    assert "Name: Fresh" in out and "b.js" not in out and "A.java" in out
    index = Index(spark, str(tmp_path / "i"))
    assert index.followed()
    index.clear()
    assert not index.followed() and "Name: Fresh" in session("Fresh")


def test_buckets_are_written_by_several_tasks(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=1)
    index.build(spark.createDataFrame([(f"/{i}.xml", b"<a/>") for i in range(50)], "path string, content binary"))
    assert Index(spark, str(tmp_path / "i")).buckets == 1
    files = list((tmp_path / "i" / "blocks").glob("v=*/bucket=0/*.parquet"))
    assert len(files) > 1 and index.blocks().count() == 50


def test_a_failing_model_loses_only_its_texts(spark):
    class Failing:
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "id int, text string").coalesce(1)
    assert sorted(r["id"] for r in embed_texts(rows, Failing()).collect()) == [1, 3]


def test_search_tool():
    asked = []
    search = lambda r: asked.append(r) or "found"
    call = lambda **fields: {"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": fields}}
    lines = [
        {"id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        call(query="find user", lang="java", limit=3, context="2", path="src"),
        call(limit=3),
        call(query="x", limit="3"),
        {"id": 4, "method": "nothing"},
    ]
    sink = io.StringIO()
    serve(search, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and got[0]["result"]["instructions"]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["search"]
    assert got[2]["result"] == {"content": [{"type": "text", "text": "found"}], "isError": False}
    assert asked == [Request("find user", lang="java", limit=3, context="2", path="src")]
    assert [g["error"]["code"] for g in got[3:]] == [-32602, -32602, -32601, -32700]
    assert line_request("plain words\n") == Request("plain words")
    assert line_request('{"query": "q", "limit": 2}') == Request("q", limit=2)


def test_stream_follows_the_tree(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=2)
    check = str(tmp_path / "check")

    def settle():
        q = follow(spark, tree, index, check, seconds=1)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    settle()
    assert {n for *_, n, _ in state(index)} == {"A", "find", "a", "q"}
    root = os.path.realpath(tree)
    time.sleep(0.02)
    with open(f"{root}/src/A.java", "w") as f:
        f.write("class Renamed { }")
    os.remove(f"{root}/src/b.js")
    settle()  # the same query goes on after a restart
    assert {n for *_, n, _ in state(index)} == {"Renamed", "a", "q"}
    assert set(snapshot(root)) == {f"{root}/src/A.java", f"{root}/keep.xml", f"{root}/bad.xml"}


def test_embedders(tmp_path):
    import numpy as np

    v = np.array(HashingEmbedder(32).embed(["find user", "", "find user"]))
    assert np.allclose((v * v).sum(1), [1, 0, 1], atol=1e-6) and (v[0] == v[2]).all()
    assert unit(np.zeros((1, 3))).tolist() == [[0, 0, 0]]
    hidden = np.array([[[1.0, 1.0], [3.0, 5.0], [9.0, 9.0]]])
    assert mean_pool(hidden, np.array([[1, 1, 0]])).tolist() == [[2.0, 3.0]]
    with pytest.raises(FileNotFoundError):
        OnnxEmbedder(str(tmp_path))


def test_table_function(spark):
    from corvine.plans.index import register_blocks_function

    register_blocks_function(spark)
    rows = spark.createDataFrame([("/a.java", b"class A { int f() { return 1; } }"), ("/b.xml", b"</a>"), ("/c.txt", None)], "path string, content binary")
    rows.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.path, b.kind, b.name FROM some_files f, LATERAL code_blocks(f.path, f.content) b").collect()
    assert sorted(tuple(r) for r in got) == [("/a.java", "Class", "A"), ("/a.java", "Method", "f")]
