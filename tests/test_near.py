"""Spans around lines and near fingerprints against comparisons of all with all."""

import random
from collections import Counter

import pytest

from quillgraph.operators import merkle, search


def test_enclosing(spark):
    rng = random.Random(6)
    spans = [(rng.choice("ab"), s := rng.randrange(0, 300), s + rng.choice([-1, 0, 1, 7, 100, 5000]), i) for i in range(80)] + [("a", 5, 9, 900), ("a", 10, 12, 901), ("a", 5, 9, 900), ("b", 3, None, 902), (None, 1, 5, 903)]
    points = [(rng.choice(["a", "b", "c"]), rng.randrange(0, 400), i % 5) for i in range(120)] + [("a", 9, 1), ("a", 9, 1), (None, 3, 2), ("b", None, 3)]
    p = spark.createDataFrame(points, "path string, line int, k int")
    s = spark.createDataFrame(spans, "path string, start_line int, end_line int, name int")
    want = Counter()
    for q in points:
        own = [x for x in spans if None not in (q[0], q[1], x[2]) and x[0] == q[0] and x[1] <= q[1] <= x[2]]
        want.update([(*q, *x[1:]) for x in own] or [(*q, None, None, None)])
    assert Counter(map(tuple, merkle.enclosing(p, s).collect())) == want
    assert merkle.enclosing(p, s.limit(0)).filter("name is not null").count() == 0 and merkle.enclosing(p.limit(0), s).count() == 0


def test_one_large_file(spark):
    """10^5 spans and 3 * 10^5 points of one file, each point in two spans."""
    p = spark.range(300_000).selectExpr("'f' as path", "id as line")
    s = spark.range(99_999).selectExpr("'f' as path", "3 * id as start_line", "3 * id + 2 as end_line").unionByName(spark.createDataFrame([("f", 0, 10**9)], "path string, start_line long, end_line long"))
    assert merkle.enclosing(p, s).count() == 299_997 * 2 + 3


@pytest.mark.parametrize("threshold", [0, 10, 12, 16])
def test_similar_all(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [(i, signed(flip(rng.choice(base), rng.randrange(0, 20)))) for i in range(300)] + [(1000 + i, signed(base[0])) for i in range(30)] + [(None, 5), (2000, None)]
    asks = [(f"q{i}", signed(flip(b, i % 3))) for i, b in enumerate(base)] + [("again", signed(base[0])), ("again", signed(base[0])), ("none", None)]
    got = search.similar_all(spark.createDataFrame(prints, "id long, fingerprint long"), spark.createDataFrame(asks, "question string, fingerprint long"), threshold, 7).collect()
    want = Counter()
    for q, f in asks:
        near = sorted((bin((f ^ g) & (1 << 64) - 1).count("1"), i) for i, g in prints if None not in (i, f, g))
        want.update((q, r, i, d) for r, (d, i) in enumerate([x for x in near if x[0] <= threshold][:7], 1))
    assert Counter(map(tuple, got)) == want
    with pytest.raises(ValueError):
        search.similar_all(None, None, 20)
