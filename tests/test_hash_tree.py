"""Trees of hashes: comparisons against whole states, rebuilding against building, work that follows changes."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.operators import hash_tree

SCHEMA = "path string, root_hash string"


def rows(df):
    return Counter((r["level"], r["node"], r["hash"], r["files"], r["path"]) for r in df.collect())


def test_compare_and_rebuild(spark, tmp_path):
    rng = random.Random(2)
    old = {f"p/{i}": str(i) for i in range(600)}
    for step, n in enumerate((0, 3, 200)):
        new = dict(old)
        for path in rng.sample(sorted(old), n):
            if rng.random() < 0.3:
                del new[path]
            else:
                new[path] += "!"
        new |= {f"q/{i}": "n" for i in range(n // 3)}
        depth = hash_tree.depth_for(len(old))
        made = lambda s: hash_tree.tree(spark.createDataFrame(sorted(s.items()), SCHEMA), depth)
        a, b = (hash_tree.stored(made(s), str(tmp_path / f"{step}{k}")) for k, s in enumerate((old, new)))
        kind = lambda p: "added" if p not in old else "removed" if p not in new else "modified"
        want = {(p, kind(p)) for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
        figures = {}
        assert Counter(map(tuple, hash_tree.compare(a, b, depth, figures).collect())) == Counter(want)
        if n == 0:
            assert figures == {0: 1}
        changes = spark.createDataFrame([(p, new.get(p)) for p, _ in want] + [(None, "x")], SCHEMA)
        assert rows(hash_tree.rebuilt(a, changes, depth)) == rows(b)


def test_work_follows_changes(spark, tmp_path):
    """Of 100,000 files three change: 16 children of at most three nodes a level are compared, and the files of three leaves."""
    n, depth = 100_000, hash_tree.depth_for(100_000)
    files = spark.range(n).select(F.concat(F.lit("p/"), "id").alias("path"), F.col("id").cast("string").alias("root_hash"))
    a = hash_tree.stored(hash_tree.tree(files, depth), str(tmp_path / "a"))
    changes = spark.createDataFrame([("p/7", "x"), ("p/70000", None), ("new", "y")], SCHEMA)
    b = hash_tree.stored(hash_tree.rebuilt(a, changes, depth), str(tmp_path / "b"))
    figures = {}
    assert set(map(tuple, hash_tree.compare(a, b, depth, figures).collect())) == {("p/7", "modified"), ("p/70000", "removed"), ("new", "added")}
    assert depth == 3 and figures[0] == 1 and all(figures[k] <= 48 for k in (1, 2, 3)) and figures[4] <= 3 * 3 * hash_tree.FILL
    assert b.filter("level = 0").first()["files"] == n and a.filter(f"level = {depth}").agg(F.max("files")).first()[0] <= 2 * hash_tree.FILL


def test_empty_and_odd(spark, tmp_path):
    none = hash_tree.tree(spark.createDataFrame([], SCHEMA), 1)
    one = hash_tree.tree(spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None), (None, "3")], SCHEMA), 1)
    assert none.count() == 0 and hash_tree.compare(none, none, 1).count() == 0
    assert [tuple(r) for r in hash_tree.compare(none, one, 1).collect()] == [("a", "added")]
    assert rows(hash_tree.rebuilt(none, spark.createDataFrame([("a", "1")], SCHEMA), 1)) == rows(one)
    assert hash_tree.rebuilt(one, spark.createDataFrame([("a", None)], SCHEMA), 1).count() == 0
