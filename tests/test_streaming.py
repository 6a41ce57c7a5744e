"""Streams run to their end over a few files."""

from quillgraph.sources.vault import Vault
from quillgraph.streaming import watch


def brute(times, window, most):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


def test_rate_limit(spark):
    import random

    rnd = random.Random(3)
    hits = [(f"k{rnd.randrange(4)}", float(i)) for i in range(300)]
    got = {}
    for r in watch.rate_limit(spark.createDataFrame(hits, "key string, t double"), 20.0, 3).collect():
        got[r.key, r.t] = r.allowed
    for key in {k for k, _ in hits}:
        times = [t for k, t in hits if k == key]
        assert [got[key, t] for t in times] == brute(times, 20.0, 3)


def test_rate_limit_stream(spark, tmp_path):
    rows = [("a", float(i)) for i in range(6)] + [("b", 0.0)]
    spark.createDataFrame(rows, "key string, t double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, t double").parquet(str(tmp_path / "in"))
    q = watch.rate_limit_stream(stream, 100.0, 3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.key, r.t, r.allowed) for r in spark.sql("select * from limited").collect()) == [("a", float(i), i < 3) for i in range(6)] + [("b", 0.0, True)]


def test_watch(spark, tmp_path):
    def to_graph(pages):
        v = Vault(pages)
        return v.edges.select("source", "target"), v.pages.select("page", "path")

    seen = []
    w = watch.Watch(spark, to_graph, lambda df, epoch: seen.append({(r.event, r.page, r.target) for r in df.collect()}))
    put = lambda *rows: spark.createDataFrame(rows, "path string, content string, seq int")
    put(("A.md", "[[B]]", 1), ("B.md", "hi", 2)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string, seq int").parquet(str(tmp_path / "in"))
    w.start(stream, 10, str(tmp_path / "c")).processAllAvailable()
    w.batch(put(("A.md", "[[B]]", 3)), 1)
    w.batch(put(("B.md", None, 4)), 2)
    for q in spark.streams.active:
        q.stop()
    assert len(seen) == 2
    assert ("page_added", "A", None) in seen[0] and ("link_added", "A", "B") in seen[0] and ("index_updated", None, None) in seen[0]
    assert {("page_removed", "B", None), ("dead_gained", "A", "B")} <= seen[1]


def test_first_seen(spark, tmp_path):
    items = spark.createDataFrame([("g1", "l1", "", 1), ("g1", "l2", "", 2), ("g2", "l1", "", 3), ("g3", "l3", "h", 4)], "guid string, link string, hash string, seq int")
    step = watch.first_seen(items, str(tmp_path / "known"))
    step(items, 0)
    step(spark.createDataFrame([("g9", "l3", "", 5), ("g8", "l8", "", 6)], "guid string, link string, hash string, seq int"), 1)
    assert sorted(r.guid for r in spark.read.parquet(str(tmp_path / "known")).collect()) == ["g1", "g3", "g8"]


def test_first_seen_again(spark, tmp_path):
    """An epoch that runs again gives what it gave; empty signals match nothing."""
    rows = [("g1", "", "", 1), ("g1", "l1", "", 2), ("", "", "", 3), ("", "", "", 4)]
    items = spark.createDataFrame(rows, "guid string, link string, hash string, seq long")
    step, path = watch.first_seen(items, str(tmp_path / "seen")), str(tmp_path / "seen")
    told = lambda: sorted((r.guid, r.link) for r in spark.read.parquet(path).collect())
    step(items, 0)
    once = told()
    step(items, 0)
    assert told() == once == [("", ""), ("", ""), ("g1", "")]
    step(items.filter("seq = 2"), 1)
    assert told() == once


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    seen = []

    def to_graph(pages):
        v = Vault(pages)
        return v.edges.select("source", "target"), v.pages.select("page", "path")

    def new():
        return watch.Watch(spark, to_graph, lambda df, epoch: seen.append((epoch, {(r.event, r.page) for r in df.collect()})), str(tmp_path / "state"))

    schema = "path string, seq long, content string"
    new().batch(spark.createDataFrame([("a.md", 1, "[[b]]"), ("b.md", 1, "x")], schema), 0)
    later = spark.createDataFrame([("b.md", 2, None), ("c.md", 2, "y")], schema)
    new().batch(later, 1)
    new().batch(later, 1)  # the driver died before the stream knew that the epoch was done
    assert seen[1] == seen[2] and ("page_removed", "b") in seen[1][1] and ("page_added", "c") in seen[1][1] and ("page_added", "a") not in seen[1][1]
    assert {r.path for r in new().pages.collect()} == {"a.md", "c.md"}
