"""Ranked search, the line field and the filter audit against brute force, and on odd rows."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import audit, line_crf, queries, ranked

D = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def by_definition(docs, items, k):
    """[(item, rank, doc, score)] of (id, text) rows, term by term."""
    counted = [(d, Counter(tokens(t))) for d, t in docs]
    n_docs, length = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(tokens(t))
    out = []
    for i, own in asked.items():
        hits = []
        for d, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(i, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return out


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(some, weights, k=rng.choice([0, 1, 3, 8, 8, 8, 40])))) for i in range(n)]


def test_terms():
    text = "A-b c_D e\tÄÖ [x]É 0aZ q {é} \x7f"
    assert [t.decode() for t in ranked.terms(text)] == tokens(text) and ranked.terms(None) == []


def test_treaps_against_all_documents():
    docs = corpus(3, 3000)
    counted = [(i, Counter(tokens(t))) for i, t in docs]
    names = sorted({t for _, c in counted for t in c})
    rows = pa.table({"id": [i for i, _ in counted], "n": [sum(c.values()) for _, c in counted], "terms": pa.array([list(c) for _, c in counted], pa.list_(pa.string())), "often": pa.array([list(c.values()) for _, c in counted], pa.list_(pa.int64()))})
    length = int(sum(sum(c.values()) for _, c in counted))
    segment = ranked.Segment(rows, pa.array(names), len(docs), length)
    # search order and heap order of every treap
    for t, root in segment.root.items():
        stack, found = [(root, -1, len(docs))], []
        while stack:
            x, low, high = stack.pop()
            if x == segment.none:
                continue
            assert low < segment.doc[x] < high
            found.append(x)
            for y in (segment.left[x], segment.right[x]):
                assert segment.impact[y] <= segment.impact[x]
            stack += [(segment.left[x], low, segment.doc[x]), (segment.right[x], segment.doc[x], high)]
        assert len(found) == sum(1 for _, c in counted if names[t] in c)
    rng = random.Random(5)
    for _ in range(60):
        question = [(t, rng.choice([1, 5, 700, 9000])) for t in rng.sample(range(len(names)), rng.choice([1, 2, 7, 30]))]
        score = Counter()
        for t, w in question:
            a = np.searchsorted(segment.key, [t * segment.size, (t + 1) * segment.size])
            for d, i in zip(segment.doc[a[0] : a[1]].tolist(), segment.impact[a[0] : a[1]].tolist()):
                score[d] += w * i
        best = ranked.Best(10)
        segment.search(question, best)
        assert [(d, -s) for s, _, d in best.rows] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_treaps_prune():
    """A range whose bound can't reach the best isn't scored: with one frequent and one rare term few documents are."""
    docs = [(i, "the " + "x " * (i % 7) + ("rare" if i % 400 == 0 else "")) for i in range(20_000)]
    counted = [(i, Counter(tokens(t))) for i, t in docs]
    names = ["rare", "the"]
    rows = pa.table({"id": [i for i, _ in counted], "n": [sum(c.values()) for _, c in counted], "terms": pa.array([list(c) for _, c in counted], pa.list_(pa.string())), "often": pa.array([list(c.values()) for _, c in counted], pa.list_(pa.int64()))})
    segment = ranked.Segment(rows, pa.array(names), len(docs), sum(sum(c.values()) for _, c in counted))
    scored, plain = [], segment._scores

    def counting(*a):
        out = plain(*a)
        scored.append(len(out[0]))
        return out

    segment._scores = counting
    segment.search([(0, 6000), (1, 3)], ranked.Best(10))
    assert sum(scored) < 4_000


@pytest.mark.parametrize("block", [ranked.BLOCK_TERMS, 20])
def test_search(spark, block, monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", 100)
    docs = [*corpus(1, 700), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5000, None), (5001, ""), (12, "w1 w2 w3"), (12, "w1 w2 w3"), (5002, "É" * 100_000 + " w5"), (5003, "w7 " * 50_000)]
    items = [(1, "W1 w2, w3!"), (2, "w40 w41 é"), (3, None), (4, "--"), (5, "nowhere"), (6, " ".join(f"w{i}" for i in range(60))), (1, "w9"), (None, "w5 w6"), (7, "w50"), (7, "w50")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string").repartition(5)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n int")
    found = sorted(map(tuple, ranked.search(d, q, 20, block_terms=block).collect()), key=repr)
    assert found == sorted(by_definition(docs, items, 20), key=repr)
    assert ranked.search(d.limit(0), q).count() == 0 == ranked.search(d, q.limit(0)).count()


def test_search_by_names(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "two one"), ("c", "three")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in ranked.search(d, q).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


# the line field


def enumerated(node, trans):
    """log Z, marginals of good and expected pairs by all labellings."""
    n = len(node)
    z, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(node[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    return math.log(z), good / z, pairs / z


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(4)
    chains = [rng.normal(size=n) * 2 for n in (1, 2, 3, 7, 9)]
    trans = rng.normal(size=(2, 2))
    node, there = np.zeros((5, 9)), np.zeros((5, 9), bool)
    for i, c in enumerate(chains):
        node[i, : len(c)], there[i, : len(c)] = c, True
    log_z, good, pairs = line_crf.chain_sums(node, there, trans)
    for i, c in enumerate(chains):
        z, g, p = enumerated(c, trans)
        assert np.isclose(log_z[i], z) and np.allclose(good[i, : len(c)], g) and np.allclose(pairs[i], p)
        assert np.allclose(line_crf.marginals(c, trans), g)


def test_gradient():
    rng = np.random.default_rng(5)
    x, there = rng.normal(size=(4, 6, 3)), np.arange(6) < np.array([[6], [1], [4], [2]])
    y, by, w = (rng.random((4, 6)) < 0.5) * there, rng.random(4), rng.normal(size=7)
    value, slope = line_crf.crf_gradient(w, x, y, there, by)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        assert np.isclose((line_crf.crf_gradient(w + step, x, y, there, by)[0] - value) / 1e-6, slope[i], atol=1e-4)


def test_parts_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = "\n".join(rng.choice(["A line of prose, as it is.", "x | y | z |", "", "SHOUT!! IT!!"]) for _ in range(57))
    field = line_crf.LineField(np.random.default_rng(1).normal(size=4 * len(line_crf.NAMES) + 3), np.array([[1.0, -1.0], [-1.0, 1.0]]))
    whole = field.line_marginals(text)
    monkeypatch.setattr(line_crf, "CHUNK_LINES", 10)
    assert all(np.allclose(a, b) for a, b in zip(whole, field.line_marginals(text))) and len(whole[0]) == 57


@pytest.mark.parametrize("text", ["A" * 2_000_000 + "a", "a!" * 1_000_000, "!" * 2_000_000, "\n" * 300_000, "x\n" * 200_000, "A b " * 400_000, "é" * 2_000_000], ids=range(7))
def test_very_long_texts(text):
    began = time.time()
    own = line_crf.own_features(line_crf.lines_of(text))
    assert len(own) == text.count("\n") + 1 and 0 <= own.min() and own.max() <= 1 and time.time() - began < 20


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op12_line_quality"](spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, _, y in judged if y], [s for s, _, y in judged if not y]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(p == y for _, p, y in judged) >= 0.97 * len(judged) and sum(p for _, p, y in judged if y) >= 0.98 * len(good)


def test_line_quality_of_odd_rows(spark):
    prose, noise = "It was a day like others.\nNobody said a word about it.", "x### y### z###\nA!! B!! C!! D!!"
    docs = [(i, prose + f" {i}" if i % 2 else noise + f" {i}###", 5.0) for i in range(80)] + [(None, prose, 1.0), (None, None, 1.0), (900, ""), (900, noise), (3, prose + " 3"), (3, prose + " 3")]
    docs = [(*r, None)[:3] for r in docs]
    labels = [(i, i % 2, 0) for i in range(80)] + [(None, 1, 1), (3, 1, None), (6, 1, 0), (8, None, 0), (7777, 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")  # noqa: E741
    rows = line_crf.quality_scores(d, l).collect()
    assert len(rows) == len(docs) and not any(r.held_out for r in rows if r.doc_id is None)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 80)
    one = {r.score for r in rows if r.doc_id == 3}
    assert len(one) == 1 and len({r.score for r in rows if r.n_lines == 1}) == 1
    # labels of held-out rows, and other columns, change nothing
    turned = l.withColumn("quality", line_crf.F.when(line_crf.held_out(line_crf.F.col("doc_id")), 1 - line_crf.F.col("quality")).otherwise(line_crf.F.col("quality")))
    assert sorted(map(repr, line_crf.quality_scores(d.withColumn("lang", line_crf.F.col("doc_id")), turned).collect())) == sorted(map(repr, rows))
    assert line_crf.quality_scores(d.limit(0), l).count() == 0 and {r.score for r in line_crf.quality_scores(d, l.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in line_crf.quality_scores(d, l.filter("quality = 1")).collect()} == {1}


# the filter audit


def audited(docs, labels):
    """Every figure by walking each order for each document."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for d, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part or "", "".join(order), step), [0] * 6)
                now = fails[f] and not gone
                row[0] += not gone and not fails[f]
                row[1] += now
                row[2] += fails[f] and gone
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += now and d in good
                row[5] += now and d in toxic
                gone = gone or fails[f]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_walking_orders(spark):
    rng = random.Random(8)
    texts = [None, "", "Ä ö", "UP Case #", " ".join(f"v{i}" for i in range(60)), "a b " * 40, " ".join(f"w{i}" for i in range(70)) + " $", "\x0b\x1c  x", "x" * 500_000, "a " * 100_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "p", "q"])) for _ in range(120)]
    docs += docs[:20]
    labels = [(rng.choice([None, *range(50)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, n int, mask int")
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")  # noqa: E741
    rows = audit.interaction_audit(d, l).collect()
    assert len(rows) == 3 * 600 and set(map(tuple, rows)) == audited(docs, labels)
    assert audit.interaction_audit(d.limit(0), l).count() == 0 and audit.interaction_audit(d, l.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_shapley_adds_up(spark):
    rows = queries.QUERIES["op13_filter_audit"](spark, D).filter("filter_order = 'ABCDE'").groupBy("part").agg({"shapley": "sum", "removed": "sum"}).collect()
    assert all(r["sum(shapley)"] == 120 * r["sum(removed)"] for r in rows)
