"""Near duplicates against all pairs."""

import random

import pytest

from quillgraph.llm import near_dedup
from quillgraph.llm.common import among, without
from quillgraph.llm.near_dedup import near_duplicates


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def edited(seed, n=250):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rnd.choice(vocabulary) for _ in range(110)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((7 * i + 2, " ".join(text)))
    passage = " ".join(base[:60])
    rows += [(10_000 + i, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(15))) for i in range(40)]
    return rows + [(20_000 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 9)))) for i in range(40)]


@pytest.mark.parametrize(("width", "percent", "small"), [(3, 85, 64), (5, 80, 6)])
def test_against_all_pairs(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "ASKED", 9)
    monkeypatch.setattr(near_dedup, "MEMBERS", 20)
    rows = edited(width)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_edges(spark):
    rows = [(None, "a b c d", 1), (None, None, 1), (5, "", 2), (6, " \t\n", 2), (7, None, 2), (8, "Solo  Word", 3), (9, "solo word", 3), (3, "one two three four five", 4), (3, "one two three four five", 4), (4, "ONE TWO THREE FOUR FIVE", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(df, width=3, percent=85).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, -1, True), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)]
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [6, 23])
def test_bitmap_filters(spark, bits):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "n")], "k long, t string")
    keys = spark.createDataFrame([(i,) for i in range(0, 700, 7)] + [(None,)], "k long")
    got = {r.k for r in among(df, "k", keys, bits).collect()}
    rest = [r.k for r in without(df, "k", keys, bits).collect()]
    assert got == set(range(0, 500, 7)) and set(rest) == {None, *range(500)} - got and len(rest) == 501 - len(got)
    assert without(df, "k", keys.limit(0), bits).count() == 501 and among(df, "k", keys.limit(0), bits).count() == 0


def test_two_groups_that_share_a_passage(spark, monkeypatch):
    """Large groups of near copies and lone documents that share buckets but don't link: all exact, in few comparisons."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared, rows = draw(80), []
    for g in range(3):
        base = shared + draw(24)
        for _ in range(60):
            text = list(base)
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join(shared + draw(20))) for i in range(60)]
    asked = []
    links = near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *a: asked.append(pairs.count()) or links(pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)
    assert asked[0] <= 64 * len(rows) and sum(asked[1:]) < 3 * len(rows), asked


def test_ids_with_several_texts(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rnd.randrange(0, 5)):
            text[rnd.randrange(60)] = rnd.choice(vocabulary)
        rows.append((i // 2, " ".join(text)))
    sets = [shingles(t, 3) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == {(d, find(d)) for d, _ in rows}
