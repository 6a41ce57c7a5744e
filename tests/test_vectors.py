"""The vector index against a comparison of all with all."""

import numpy as np

from quillgraph.operators import search
from quillgraph.operators.vectors import VectorIndex, fit_centroids, scores


def test_nearest(spark, tmp_path, monkeypatch):
    from quillgraph.operators import vectors

    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(15)] + [(None, rows[0][1]), (3000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "i"), cells=20, sample=300)
    index = VectorIndex(spark, str(tmp_path / "i"))
    asked = [(f"q{i}", rows[i][1]) for i in range(0, 900, 60)] + [("zero", [0.0] * 8), ("again", rows[5][1]), ("again", rows[5][1]), (None, rows[5][1]), ("none", None)]
    got = {}
    for r in index.nearest(spark.createDataFrame(asked, "question string, vector array<double>"), 10).collect():
        got.setdefault(r.question, []).append((r.rank, r.id, r.score))
    known = [r for r in rows if None not in r]
    ids = np.array([r[0] for r in known])
    for q, v in dict(a for a in asked if None not in a).items():
        s = scores(np.array([v]), np.array([r[1] for r in known]))[0]
        order = np.lexsort((ids, -s))[:10]
        assert sorted(got[q]) == [(i + 1, int(ids[o]), float(s[o])) for i, o in enumerate(order)], q
    assert set(got) == {a[0] for a in asked if None not in a} and index.share_read < 0.5
    one = search.vector_top(df.filter("embedding is not null and vec_id is not null"), rows[60][1], 10).collect()
    assert [(r.id, r.score) for r in one] == [(i, s) for _, i, s in sorted(got["q60"])]
    assert index.nearest(spark.createDataFrame([], "question string, vector array<double>")).count() == 0


def test_an_empty_index(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path / "e"))
    assert index.nearest(spark.createDataFrame([("q", [1.0])], "question string, vector array<double>")).count() == 0
    assert len(fit_centroids(np.ones((5, 2)), 3)) == 1
