"""Shards as files: each row once, in its shard's folder, in the order of slots."""

from quillgraph.llm import shard


def test_written_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shard, "RANGE_ROWS", 10_000)
    rows = [(i, None if i % 50 == 0 else f"text {i % 7} " * (i % 13), "s", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot_name int")
    path = str(tmp_path / "out")
    shard.write_shards(df, path, 4)
    places = {r.doc_id: (r.shard, r.slot) for r in shard.assign_shards(df, 4).collect()}
    back = spark.read.parquet(path)
    assert {(r.doc_id, r.text, r.source, r.slot_name) for r in back.collect()} == set(rows) and back.count() == 300
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == places
    for k in range(4):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [[r.slot for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in files]
        assert all(s == sorted(s) for s in slots) and sum(map(len, slots)) == sum(1 for s, _ in places.values() if s == k)
