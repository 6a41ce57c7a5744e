"""The sink by epochs: repeated and killed epochs leave each line once."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import epochs

SCHEMA = "id long, name string"


def lines(spark, root, **k):
    return Counter(map(tuple, epochs.read(spark, str(root), SCHEMA, **k).collect()))


def test_batch_once(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("ä"), "id").alias("name"))
    for epoch in (0, 0, 1):
        epochs.append_once(df.filter(f"id % 2 = {epoch}"), str(tmp_path), epoch)
    assert lines(spark, tmp_path) == Counter((i, f"ä{i}") for i in range(100))
    assert lines(spark, tmp_path, after=0) == Counter((i, f"ä{i}") for i in range(1, 100, 2))
    assert epochs.sweep(str(tmp_path)) == 0 and {m["lines"] for m in epochs.happened(str(tmp_path)).values()} == {50}


def test_failed_epoch_leaves_nothing_named(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(Exception):
        epochs.append_once(df, str(tmp_path), 0)
    assert epochs.happened(str(tmp_path)) == {} and not lines(spark, tmp_path)
    epochs.append_once(df.filter("id < 99"), str(tmp_path), 0)
    assert sum(lines(spark, tmp_path).values()) == 99
    epochs.sweep(str(tmp_path))
    assert sum(lines(spark, tmp_path).values()) == 99


def test_stream_restarted(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    stream = lambda: spark.readStream.schema(SCHEMA).json(src)
    put = lambda ids: spark.createDataFrame([(i, str(i)) for i in ids], SCHEMA).coalesce(1).write.mode("append").json(src)
    put(range(10))
    broken = stream().withColumn("name", F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    query = epochs.start(broken, out, mark)
    with pytest.raises(Exception):
        query.awaitTermination()
    assert not lines(spark, out)
    epochs.start(stream(), out, mark).awaitTermination()
    put(range(10, 15))
    epochs.start(stream(), out, mark).awaitTermination()
    want = Counter((i, str(i)) for i in range(15))
    assert lines(spark, out) == want
    # another checkpoint: its first epoch holds all that this root has in two
    with pytest.raises(Exception, match="other lines"):
        epochs.start(stream(), out, mark + "2").awaitTermination()
    assert lines(spark, out) == want


def test_commit_again_and_abort(tmp_path):
    w = epochs._Stream(str(tmp_path))
    first, second = w.write(iter([("a",), (None,), ("b",)])), w.write(iter([("a",), ("b",)]))
    w.commit([first, None], 3)
    w.commit([second], 3)
    assert [p.name for p in (tmp_path / "parts").iterdir()] == [first.name] and (first.lines, w.write(iter([])).name) == (2, None)
    w.abort([third := w.write(iter([("c",)])), None], 4)
    assert not (tmp_path / "parts" / third.name).exists() and list(epochs.happened(str(tmp_path))) == [3]
    with pytest.raises(ValueError):
        w.write(iter([("a\nb",)]))
    assert json.loads((tmp_path / "epochs" / "000000000003.json").read_text())["lines"] == 2


def test_empty(spark, tmp_path):
    assert not lines(spark, tmp_path) and epochs.sweep(str(tmp_path)) == 0
    epochs.append_once(spark.createDataFrame([], SCHEMA), str(tmp_path), 0)
    assert not lines(spark, tmp_path) and list(epochs.happened(str(tmp_path))) == [0]
