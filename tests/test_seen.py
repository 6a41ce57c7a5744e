"""First-seen items against taking them one by one, whatever the batches; restarts, forgetting, work by buckets."""

import random

from quillgraph import plans
from quillgraph.streaming import seen

SCHEMA = "guid string, link string, hash string, seq long"


def one_by_one(items):
    lent, new = set(), []
    for i in sorted(items, key=lambda i: (i[3], i[:3])):
        own = {(k, v) for k, v in zip(seen.SIGNALS, i) if v}
        if not own & lent:
            lent |= own
            new.append(i)
    return sorted(new, key=repr)


def run(spark, root, batches, again=(), **k):
    out = {}
    step = seen.FirstSeen(spark, str(root), lambda df, e: out.__setitem__(e, [tuple(r) for r in df.select("guid", "link", "hash", "seq").collect()]), n=8, **k)
    for e, b in enumerate(batches):
        for _ in range(2 if e in again else 1):
            step(spark.createDataFrame(b, SCHEMA), e)
    return sorted((i for rows in out.values() for i in rows), key=repr), step


def test_any_batches(spark, tmp_path):
    rng = random.Random(6)
    pick = lambda c: rng.choice([None, "", *(f"{c}{i}" for i in range(25))])
    items = [(pick("g"), pick("l"), pick("h"), i) for i in range(90)]
    assert run(spark, tmp_path / "one", [items])[0] == one_by_one(items)
    assert run(spark, tmp_path / "three", [items[:20], items[20:21], [], items[21:]], again=(1, 3))[0] == one_by_one(items)


def test_what_a_repeat_has_is_not_lent(spark, tmp_path):
    """The second shares a link with the first, so the third, which shares its guid, is new; the chain takes rounds."""
    items = [("g1", "l1", "", 1), ("g2", "l1", "", 2), ("g2", "l3", "", 3), ("g4", "l3", "", 4), ("g4", "", "", 5)]
    found, step = run(spark, tmp_path, [items])
    assert found == one_by_one(items) == [items[0], items[2], items[4]] and step.rounds == 3


def test_copies_and_odd_rows(spark, tmp_path):
    items = [("g", "l", "h", 1)] * 500 + [(None, None, None, 2), ("", "", "", 3), (None, "", None, 2)]
    found, step = run(spark, tmp_path, [items])
    assert len(found) == 4 and found.count(items[0]) == 1 and step.rounds == 1


def test_forgets(spark, tmp_path):
    first, later = [("g", "l", "", 1), ("k", "", "", 50)], [("g", "", "", 100), ("k", "", "", 101)]
    assert run(spark, tmp_path / "keeps", [first, later])[0] == sorted(first, key=repr)
    assert run(spark, tmp_path / "forgets", [first, later], keep=60)[0] == sorted([*first, later[0]], key=repr)


def test_reads_what_it_asks_for(spark, tmp_path):
    _, step = run(spark, tmp_path, [[(f"g{i}", f"l{i}", "", i) for i in range(400)], [("g5", "", "", 500)]])
    assert step.buckets.read_buckets == 1 and step.buckets.written < 200


def test_query(spark):
    found = [tuple(r) for r in plans.QUERIES["first_seen_items"](spark, "/root/testdata/sf0.001").select("guid", "link", "hash", "seq").collect()]
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("concat_ws('/', user_id, event_type)", "concat_ws('/', date_format(ts, 'yyyy-MM-dd HH:mm'), event_type)", "coalesce(cast(value as string), '')", "event_id")
    assert sorted(found, key=repr) == one_by_one([tuple(r) for r in e.collect()]) and len(found) > 10
