"""Histories as intervals against histories of states, and a kept history against both."""

import random
from collections import Counter

import pytest

from quillgraph.operators import history, intervals


def bag(df, *names):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in df.collect())


@pytest.fixture(scope="module")
def states(spark):
    """Fourteen snapshots, some without a page, of pages that come, go, lose all links and repeat some."""
    rng, rows = random.Random(5), []
    for seq in range(2, 30, 2):
        if seq in (8, 20):
            continue
        for page in "abcdefgh":
            if rng.random() < 0.6:
                targets = rng.choices("uvwx", k=rng.randrange(4))
                rows += [(seq, page, t) for t in targets] or [(seq, page, None)]
    snaps = spark.createDataFrame([(s,) for s in range(2, 30, 2)], "seq long")
    return snaps, spark.createDataFrame(rows, "seq long, page string, target string"), rows


def test_histories_are_equal(states):
    snaps, links, _ = states
    spans = intervals.link_spans(snaps, links)
    names = ("seq", "total_pages", "total_links", "pages_added", "pages_removed", "links_added", "links_removed")
    assert bag(intervals.vault_history(snaps, spans), *names) == bag(history.vault_history(snaps, links), *names)
    names = ("page", "seq", "event", "added", "removed")
    want = [(p, s, e, tuple(sorted(a)), tuple(sorted(r))) for p, s, e, a, r in bag(history.page_history(snaps, links), *names).elements()]
    assert bag(intervals.page_history(spans), *names) == Counter(want)


def test_states_come_back(states):
    snaps, links, rows = states
    spans = intervals.link_spans(snaps, links)
    for seq in (2, 8, 14, 28):
        want = Counter((p, t) for s, p, t in rows if s == seq and t)
        assert {(p, t): n for p, t, n in bag(intervals.at(spans, seq).filter("target is not null"), "page", "target", "copies")} == want


def test_what_does_not_change_is_one_row(spark):
    snaps = spark.range(1000).withColumnRenamed("id", "seq")
    links = snaps.selectExpr("seq", "'p' as page", "if(seq = 500, 'new', 'old') as target")
    assert bag(intervals.link_spans(snaps, links), "page", "target", "copies", "since", "until") == Counter([("p", None, 0, 0, None), ("p", "old", 1, 0, 500), ("p", "new", 1, 500, 501), ("p", "old", 1, 501, None)])


def test_versions(spark):
    rows = [(1, "c1", "a", "x"), (2, "c2", "a", None), (4, "c4", "a", "y"), (2, "c2", "b", ""), (3, "c3", "c", "z")]
    files = spark.createDataFrame(rows, "seq long, change_id string, path string, content string")
    spans = intervals.version_spans(files)
    for seq in (1, 2, 3, 4):
        assert bag(intervals.at(spans, seq), "path", "content") == bag(history.tree_at(files, f"c{seq}"), "path", "content")


def test_kept_history(spark, states):
    snaps, links, rows = states
    h = intervals.kept(spark, "page string, target string, copies long")
    assert h.spans().count() == 0
    names, seqs = ("page", "target", "copies", "since", "until"), sorted(r[0] for r in snaps.collect())
    state = lambda s: intervals.link_states(links.filter(f"seq = {s}"))
    h.load(intervals.link_spans(snaps.filter("seq <= 10"), links.filter("seq <= 10")), 10)
    for s in [s for s in seqs if s > 10]:
        h.append(s, state(s))
        assert len(h.appended()) <= 2
    want = bag(intervals.link_spans(snaps, links), *names)
    assert bag(h.spans(), *names) == want
    # done again, and after an append that was cut off before its state was complete
    h.append(28, state(28))
    state(2).selectExpr("page", "target", "copies", "2L as since").write.parquet(f"{h.root}/ended/until=30")
    assert bag(h.spans(), *names) == want
    h.append(30, state(28))
    later = {k: n for k, n in bag(h.spans(), *names).items() if k[4] is not None}
    assert later == {k: n for k, n in want.items() if k[4] is not None}
    with pytest.raises(ValueError):
        h.append(12, state(12))
    then = h.at(16)
    assert bag(then.filter("target is not null"), "page", "target") == Counter({(p, t): 1 for s, p, t in rows if s == 16 and t})
    assert "PartitionFilters: [isnotnull(until" in then._jdf.queryExecution().toString()
    moved = {(p, t, c) for p, t, c in bag(h.between(14, 16), "page", "target", "came") if t}
    old, new = ({(p, t) for s, p, t in rows if s == k and t} for k in (14, 16))
    assert {(p, t) for p, t in new - old} <= {(p, t) for p, t, c in moved if c} and {(p, t) for p, t in old - new} <= {(p, t) for p, t, c in moved if not c}


def test_empty(spark):
    snaps, links = spark.createDataFrame([], "seq long"), spark.createDataFrame([], "seq long, page string, target string")
    spans = intervals.link_spans(snaps, links)
    assert spans.count() == intervals.vault_history(snaps, spans).count() == intervals.page_history(spans).count() == 0
