"""Trees listed by tasks, and their changes into an index."""

import os
import threading
import time

import pytest

from corvine.plans.index import Index
from corvine.sources import listing
from corvine.sources.scan import walk
from corvine.streaming import tree as T

FILES = {
    "a.java": "class A { }",
    "src/b.js": "function b() { }",
    "src/deep/er/c.xml": "<c/>",
    "src/build/d.java": "class D { }",
    "skip/e.java": "class E { }",
    "skip/more/f.java": "class F { }",
    "notes.txt": "x",
    "lib.jar": "x",
    "UPPER.XML": "<u/>",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "tree" / ".gitignore").write_text("skip/\n")
    return str(tmp_path / "tree")


def rels(df):
    return sorted(r["rel"] for r in df.select("rel").collect())


@pytest.mark.parametrize("partitions", ["1", "2", "64"])
def test_listing_agrees_with_the_walk(spark, root, partitions):
    own = os.path.realpath(root)
    every = listing.list_tree(spark, root, partitions=partitions, extensions="*")
    assert sorted(r["path"] for r in every.collect()) == walk(root)
    for place in (root, f"file://{own}"):
        assert rels(listing.list_tree(spark, place, partitions=partitions)) == ["a.java", "src/b.js", "src/deep/er/c.xml"]
    r = every.where("rel = 'a.java'").first()
    assert (r["ext"], r["size"], r["modified"]) == ("java", 11, os.stat(f"{own}/a.java").st_mtime_ns)
    strict = rels(listing.list_tree(spark, root, strict="true"))
    assert strict == ["a.java", "skip/e.java", "skip/more/f.java", "src/b.js", "src/deep/er/c.xml"]


def test_ignored_directories_are_never_listed(spark, root, monkeypatch):
    """They cannot even be: a directory that may not be read fails the listing, unless it is ignored."""
    listed = []
    reader = listing.TreeReader({"path": root, "partitions": "2"})
    entries = listing.LocalTree.entries
    monkeypatch.setattr(listing.LocalTree, "entries", lambda self, path: listed.append(os.path.relpath(path, self.root)) or entries(self, path))
    found = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted(r[1] for r in found) == ["a.java", "src/b.js", "src/deep/er/c.xml"]
    assert sorted(listed) == [".", "src", "src/deep", "src/deep/er"]


def test_other_stores(root):
    """The reader for other stores, on this one."""
    tree = listing.StoredTree(f"file://{root}")
    assert tree.text(f"{root}/.gitignore") == "skip/\n" and tree.text(f"{root}/none") is None
    got = {(e.name, e.directory, e.size) for e in tree.entries(root)}
    assert ("a.java", False, 11) in got and ("src", True, 0) in got


def test_links(spark, root, tmp_path):
    (tmp_path / "away" / "in").mkdir(parents=True)
    (tmp_path / "away" / "in" / "z.xml").write_text("<z/>")
    os.symlink(root, f"{root}/loop")
    os.symlink(f"{root}/src", f"{root}/again")
    os.symlink(tmp_path / "away", f"{root}/away")
    os.symlink(tmp_path / "away", f"{tmp_path}/away/in/loop")
    os.symlink(tmp_path / "none", f"{root}/none.xml")
    for partitions in ("1", "3", "64"):
        assert rels(listing.list_tree(spark, root, partitions=partitions)) == ["a.java", "away/in/z.xml", "src/b.js", "src/deep/er/c.xml"]


def test_no_tree_and_no_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert listing.list_tree(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        listing.list_tree(spark, str(tmp_path / "none")).count()


def names(index):
    return sorted(r["name"] for r in index.blocks().collect())


def write(path, text):
    time.sleep(0.01)
    with open(path, "w") as f:
        f.write(text)


def test_index_follows_published_changes(spark, root, tmp_path, monkeypatch):
    index, state = Index(spark, str(tmp_path / "i"), buckets=2), str(tmp_path / "state")
    run = lambda: T.update(spark, root, index, state, partitions="3")
    assert run() == 1 and names(index) == ["A", "b", "c"]
    assert run() is None
    write(f"{root}/a.java", "class A2 { }")
    os.remove(f"{root}/src/b.js")
    write(f"{root}/src/new.xml", "<n/>")
    assert run() == 2 and names(index) == ["A2", "c", "n"]
    changes = spark.read.schema(T.CHANGES).parquet(f"{state}/changes/version=2").collect()
    assert sorted((os.path.basename(r["path"]), r["op"], r["seq"]) for r in changes) == [("a.java", "upsert", 2), ("b.js", "remove", 2), ("new.xml", "upsert", 2)]
    # a run that ends after its snapshot: the next one makes its changes
    write(f"{root}/src/late.xml", "<late/>")
    monkeypatch.setattr(T, "_publish_changes", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run()
    monkeypatch.undo()
    assert run() is None and names(index) == ["A2", "c", "late", "n"]
    # a rule that comes to hold removes what it ignores
    write(f"{root}/.gitignore", "skip/\nsrc/\n")
    assert run() == 4 and names(index) == ["A2"]


def test_keep_updating(spark, root, tmp_path):
    index, stop = Index(spark, str(tmp_path / "i"), buckets=1), threading.Event()
    t = threading.Thread(target=T.keep_updating, args=(spark, root, index, str(tmp_path / "s"), stop, 0.1))
    t.start()
    try:
        for text, want in (("class B { }", ["A", "B", "b", "c"]), ("class B3 { }", ["A", "B3", "b", "c"])):
            write(f"{root}/B.java", text)
            until = time.time() + 90
            while time.time() < until and names(index) != want:
                time.sleep(0.2)
            assert names(index) == want
    finally:
        stop.set()
        t.join()
