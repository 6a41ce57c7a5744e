"""The incremental watch against a graph that is built anew after each change."""

import random

import pytest

from quillgraph.operators import graph
from quillgraph.sources.vault import Vault, generate
from quillgraph.streaming.vault_watch import VaultWatch


def put(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, seq long")


def rebuilt(spark, files):
    v = Vault(spark.createDataFrame(sorted(files.items()) or [], "path string, content string"))
    return v.edges.select("source", "target").distinct(), v.pages.select("page", "path")


def test_events_are_those_of_a_rebuild(spark, tmp_path):
    """Random edits of pages whose names collide in case, marks and folders."""
    rng = random.Random(11)
    paths = ["A.md", "a.md", "x/B.md", "y/B.md", "C-d.md", "z/c_d.md", "E.md", "y/F g.md"]
    says = ["[[A]]", "[[a]]", "[[B]]", "[[x/B]]", "[[C d]]", "[[c-d|x]]", "[[#top]]", "[[E]] [[E]]", "[[Nowhere]]", "[[y/F g]]", "[[f G]]", "plain"]
    seen, files, before = {}, {}, None
    w = VaultWatch(spark, lambda df, e: seen.update({e: sorted(map(tuple, df.collect()), key=repr)}), str(tmp_path / "s"), 7)
    for epoch in range(5):
        change = {p: None if rng.random() < 0.3 else "\n".join(rng.sample(says, rng.randrange(1, 4))) for p in rng.sample(paths, 4 if epoch else 7)}
        rows = [(p, c, 10 * epoch + 5) for p, c in change.items()] + [(p, "older [[E]]", 10 * epoch) for p in list(change)[:2]]
        w.batch(put(spark, rows), epoch)
        if epoch == 2:  # a driver that died after the sink, and another that goes on from the state
            again, w = seen[2], VaultWatch(spark, w.sink, str(tmp_path / "s"), 7)
            w.batch(put(spark, rows), epoch)
            assert seen[2] == again
        was = dict(files)
        files = {p: c for p, c in {**files, **change}.items() if c is not None}
        now = rebuilt(spark, files)
        old = before or (now[0].limit(0), now[1].limit(0))
        if files != was:
            diff = graph.graph_diff(*old, *now).distinct()
            want = sorted([*map(tuple, diff.collect()), ("index_updated", None, None)], key=repr)
            assert seen[epoch] == want, epoch
        assert {tuple(r) for r in w.edges.collect()} == {tuple(r) for r in now[0].collect()}
        assert {r.path for r in w.pages.collect()} == set(files)
        before = now


def test_nothing_changes(spark, tmp_path):
    seen = []
    w = VaultWatch(spark, lambda df, e: seen.append(e), str(tmp_path / "s"), 4)
    w.batch(put(spark, [("A.md", "x", 1), ("B.md", None, 1)]), 0)
    w.batch(put(spark, [("A.md", "x", 2), ("C.md", None, 2)]), 1)
    w.batch(put(spark, []), 2)
    assert seen == [0] and w.pages.count() == 1
    with pytest.raises(ValueError):
        VaultWatch(spark, print, str(tmp_path / "s"), 5).pages.count()


def test_work_follows_the_change(spark, tmp_path):
    """Of a vault of 600 pages with 7,200 links, a change of two pages writes a few buckets; old versions go."""
    w = VaultWatch(spark, lambda df, e: df.count(), str(tmp_path / "s"), 64)
    pages = generate(spark, 600).selectExpr("path", "content", "1L as seq")
    w.batch(pages, 0)
    whole, written = w.tables.written, []
    for epoch in (1, 2):
        w.batch(put(spark, [("folder_0/note_1.md", f"[[note_{epoch}]] [[ghost_{epoch}]]", epoch + 1), (f"new_{epoch}.md", "x", epoch + 1)]), epoch)
        written.append(w.tables.written / whole)
    # the first change retracts 12 links, the others 2 each
    assert written[0] < 0.2 and max(written[1:]) < 0.08, written
    names = {p.name for p in (tmp_path / "s" / "manifest").iterdir() if p.is_dir()}
    assert names == {"epoch-1", "epoch-2"} and len(list((tmp_path / "s" / "pages" / "epoch-0").glob("bucket=*"))) < 64


def test_as_a_stream(spark, tmp_path):
    seen = []
    put(spark, [("A.md", "[[B]]", 1), ("B.md", "hi", 2)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string, seq long").parquet(str(tmp_path / "in"))
    q = VaultWatch(spark, lambda df, e: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "s"), 4).start(stream, 10, str(tmp_path / "c"))
    q.processAllAvailable()
    put(spark, [("B.md", None, 3)]).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert seen[0] == {("page_added", "A", None), ("page_added", "B", None), ("link_added", "A", "B"), ("orphan_gained", "A", None), ("index_updated", None, None)}
    assert seen[1] == {("page_removed", "B", None), ("dead_gained", "A", "B"), ("index_updated", None, None)}
