"""Operators whose work, disk or memory grew faster than their input: the same results on odd inputs."""

import hashlib
import random
import re

import pytest

from quillgraph.logic.rules import Theory
from quillgraph.operators import export, graph, iterate, merkle, rdf, search, segments
from quillgraph.operators.lint import Vocabulary
from quillgraph.sources import vault
from quillgraph.streaming import seen, vault_watch


@pytest.mark.parametrize("listed", [1024, 2])
def test_closure_of_odd_names(spark, monkeypatch, listed):
    """Null ends, loops, a hub and names with the marks of lists; a pair is there once."""
    monkeypatch.setattr(iterate, "LISTED", listed, raising=False)
    steps = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("a", None), (None, "a"), ("x", "x"), ("\0", "\1n"), ("\1n", "\1b\0"), ("\1b\0", ""), ("", "\1"), *((f"h{i}", "hub") for i in range(9)), ("hub", "a"), ("hub", "y")]
    out = {}
    for s, t in set(steps):
        out.setdefault(s, set()).add(t)
    for depth in (1, 2, 3, 9):
        want = {}
        for s in out:
            front = {s}
            for hop in range(1, depth + 1):
                front = {t for f in front if f is not None or hop == 1 for t in out.get(f, ())}
                for t in front:
                    want.setdefault((s, t), hop)
        got = [tuple(r) for r in iterate.closure(spark.createDataFrame(steps, "source string, target string"), depth).collect()]
        assert len(got) == len(want) and {(s, t): h for s, t, h in got} == want


@pytest.mark.parametrize("listed", [1024, 3])
def test_closure_sends_rests_of_names(spark, monkeypatch, tmp_path, listed):
    """Lists lack what their names begin with, whatever that is; a step moves to its source once and isn't listed itself."""
    monkeypatch.setattr(iterate, "LISTED", listed, raising=False)
    monkeypatch.setattr(iterate, "GROUPED", 5)
    names = ["supplier:1", "supplier:10", "supplier:1", "supplier:", "Ünï:a", "Ünï:äb", "Ünï:", "", "\1", "other", "😀a", "😀b"]
    steps = [("p", n) for n in names[:4]] + [("q", n) for n in names[4:7]] + [("r", n) for n in names[7:10]] + [("s", n) for n in names[10:]] + [("o", x) for x in "pqrs"] + [("u", "o"), ("u", "p"), ("v", None)]
    spark.createDataFrame(steps, "source string, target string").write.parquet(str(tmp_path / "steps"))
    written, write = {}, iterate.table
    monkeypatch.setattr(iterate, "table", lambda df, name, *a: written.setdefault(name, []).append(write(df, name, *a)) or written[name][-1])
    got = [tuple(r) for r in iterate.closure(spark.read.parquet(str(tmp_path / "steps")), 3).collect()]
    two = {("o", n) for x in "pqrs" for s, n in steps if s == x}
    want = {(s, n): 3 for s, n in {("u", n) for _, n in two}} | {("u", n): 2 for n in [*"pqrs", *names[:4]]} | {k: 2 for k in two} | {k: 1 for k in steps}
    assert len(got) == len(want) and {(s, t): h for s, t, h in got} == want
    lists = {(r["head"], r["targets"]) for r in written["reach"][0].collect() if r["via"] in ("p", "q", "r", "s")}
    assert {("😀", "a\0b"), ("supplier:", "\0" + "1\0" + "10"), ("Ünï:", "\0a\0äb")} <= lists and not any("\1" in t and h for h, t in lists)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_rdf_is_that_of_the_triples(spark):
    """Equal links, two predicates with one IRI, ends without a page or null: each form as from the sorted triples."""
    edges = spark.createDataFrame([("a b", "c", "in", "x\"y", 1), ("a b", "c", "in", None, 2), ("a b", "c", "in", None, 2), ("a b", "c", "geo:in", None, 3), ("c", None, "in", "z", 4), ("q", "c", "of", None, None), ("q", "c", None, None, 1)], "source string, target string, predicate string, annotation string, line int")
    pages = spark.createDataFrame([("a b", "a.md"), ("a b", "b.md"), ("c", "c.md")], "page string, path string")
    v = Vocabulary(labels={"in": "In"}, maps_to={"in": "geo:in"}, prefixes={"geo": "http://g/"})
    found = rdf.triples(edges, pages, "http://v/", v)
    assert found.count() == found.distinct().count() == 46
    for form in ("ntriples", "turtle", "jsonld"):
        got = [r[0] for r in rdf.written(edges, pages, "http://v/", v, form).collect()]
        assert got == [r[0] for r in getattr(rdf, form)(found).collect()] and len(got) > 5


@pytest.mark.parametrize("sorted_", [1_500_000, 3])
def test_written_rdf_moves_links_twice(spark, monkeypatch, tmp_path, sorted_):
    """By source to be numbered, with their pages' paths, and to their places; also where a source's links are many ranges."""
    monkeypatch.setattr(rdf, "SORTED", sorted_, raising=False)
    rng = random.Random(11)
    links = [(rng.choice([None, "", "a", "hub", "hub", "hub", f"p{rng.randrange(9)}"]), rng.choice(["x", "y", None, "z w"]), rng.choice(["in", "in", None]), rng.choice([None, "n"]), rng.randrange(40)) for _ in range(200)]
    paths = [("hub", "h2.md"), ("hub", "h1.md"), (None, "none.md"), ("", "empty.md"), ("a", None), ("alone", "o.md"), *((f"p{i}", f"p{i}.md") for i in range(0, 9, 2)), ("zz", "last.md")]
    spark.createDataFrame(links, "source string, target string, predicate string, annotation string, line int").write.parquet(str(tmp_path / "edges"))
    edges, pages = spark.read.parquet(str(tmp_path / "edges")), spark.createDataFrame(paths, "page string, path string")
    first = lambda x: (x is not None, x or "")
    least = {s: min(p for q, p in paths if q == s and p) for s in {s for s, p in paths if s is not None and p}}
    order = sorted(links, key=lambda e: (first(e[0]), first(e[1]), first(e[2]), e[4], first(e[3])))
    want = {f"http://v/statement/{i}": f"{least[e[0]]}:{e[4]}" for i, e in enumerate(order) if e[2] and e[0] in least}
    found = rdf.triples(edges, pages, "http://v/")
    assert {r["s"]: r["o"] for r in found.filter(found["p"] == rdf.DCTERMS + "source").collect()} == want and len(want) > 50
    assert found.count() == found.distinct().count()
    for form in ("ntriples", "turtle", "jsonld"):
        out = rdf.written(edges, pages, "http://v/", None, form)
        plan = plan_of(out)
        assert [r[0] for r in out.collect()] == [r[0] for r in getattr(rdf, form)(found).collect()]
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("Exchange rangepartitioning") == 1


def test_links_are_not_sorted_to_find_dead_ones(spark):
    edges, pages = spark.createDataFrame([("a", "b"), ("b", "x"), ("c", None)], "source string, target string"), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "page string")
    dead, alone = graph.dead_links(edges, pages), graph.orphans(edges, pages)
    assert sorted(tuple(r) for r in dead.select("source", "target").collect()) == [("b", "x"), ("c", None)]
    assert sorted((tuple(r) for r in alone.collect()), key=repr) == [("a", 1), (None, 0)]
    assert "SortMergeJoin" not in plan_of(dead) and "Join" not in plan_of(alone)


def test_dead_links_are_counted_by_target(spark):
    """No table of pages is hashed beside each part of a union of links: it has to fit where that part is small."""
    s = "source string, target string"
    edges = spark.createDataFrame([("a", "b"), ("b", "x"), ("b", "x"), ("c", None)], s).unionByName(spark.createDataFrame([("a", "a"), ("q", "y")], s))
    pages = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,)], "page string")
    dead, alone = graph.dead_links(edges, pages), graph.orphans(edges, pages)
    assert sorted((tuple(r) for r in dead.select("source", "target").collect()), key=repr) == [("b", "x"), ("b", "x"), ("c", None), ("q", "y")]
    assert plan_of(dead).count("ShuffledHashJoin") == 1
    counted = graph.dead_and_orphans(edges, pages)
    assert [tuple(r) for r in counted.collect()] == [(dead.count(), alone.count())] == [(4, 2)] and "Join" not in plan_of(counted)
    told = spark.createDataFrame([("syntax", "error"), ("dead_link", "error"), (None, "info")], "kind string, level string")
    assert sorted((tuple(r) for r in graph.check_summary(edges, pages, told).collect()), key=repr) == [("dead_link", "error", 5), ("orphan", "error", 2), ("syntax", "error", 1), (None, "info", 1)]
    none = pages.limit(0)
    assert [tuple(r) for r in graph.dead_and_orphans(edges.limit(0), none).collect()] == [(0, 0)] and graph.check_summary(edges.limit(0), none, told.limit(0)).count() == 0


def test_groundings_move_leaves_once(spark, tmp_path):
    leaves = spark.createDataFrame([("f", i, t, n, i + 1, f"h{i}") for i, (t, n) in enumerate([("rules", None), ("paragraph", None), ("heading", 1), ("rules", None), ("heading", 2), ("paragraph", None), ("rules", None), ("heading", 1), ("rules", None)])], "path string, pos int, type string, level int, start_line int, hash string")
    leaves.write.parquet(str(tmp_path / "leaves"))
    found = merkle.groundings(spark.read.parquet(str(tmp_path / "leaves")))
    sha = lambda *p: hashlib.sha256("\n".join(f"h{i}" for i in p).encode()).hexdigest()
    assert {r["pos"]: r["grounding"] for r in found.collect()} == {0: sha(1), 3: sha(2, 4, 5), 6: sha(4, 5), 8: sha(7)}
    assert plan_of(merkle.groundings(spark.read.parquet(str(tmp_path / "leaves")))).count("Exchange hashpartitioning") == 1


def test_a_theory_is_parsed_once(spark):
    blocks = spark.createDataFrame([("t", "p", 0, 1, "(given a)\n(normally r a b)\n(prefer r s)")], "path string, page string, ord int, start_line int, content string")
    t = Theory.of_blocks(blocks)
    assert [r["literal"] for r in t.facts.collect()] == ["a"] and [r["head"] for r in t.rules.collect()] == ["b"] and t.superiority.count() == 1
    assert not any("MapInPandas" in plan_of(x) for x in (t.rules, t.body, t.facts, t.superiority, t.errors))


def test_repeats_of_lent_signals_stay_out_of_rounds(spark, monkeypatch, tmp_path):
    """Items in many small stretches are those taken one by one; only those that nothing before decides are written for rounds."""
    monkeypatch.setattr(seen, "STRETCH", 40, raising=False)
    rng = random.Random(3)
    items = [(f"g{rng.randrange(60)}", rng.choice([None, "", f"l{rng.randrange(300)}"]), f"h{rng.randrange(500)}", i // 3) for i in range(4000)]
    lent, want = set(), []
    for i in sorted(items, key=lambda i: (i[3], i[0], i[1] is not None, i[1] or "", i[2])):
        own = {(k, v) for k, v in zip(seen.SIGNALS, i) if v}
        if not own & lent:
            lent |= own
            want.append(i)
    written, write = {}, seen.table
    monkeypatch.setattr(seen, "table", lambda df, name: written.setdefault(name, []).append(write(df, name)) or written[name][-1])
    found = []
    step = seen.FirstSeen(spark, str(tmp_path), lambda df, e: found.extend(tuple(r) for r in df.select("guid", "link", "hash", "seq").collect()), n=8)
    step(spark.createDataFrame(items, "guid string, link string, hash string, seq long"), 0)
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(found) > 30
    assert sum(df.count() for name, dfs in written.items() if name != "items" for df in dfs) < len(items)


def test_near_pairs_that_none_needs_are_not_made(spark, monkeypatch):
    """All prints lie near each other: a question keeps as many of them as it may give, whatever the number of pairs."""
    rng = random.Random(5)
    prints = [(i, -1 ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(5)))) for i in range(400)]
    written, write = [], search.table
    monkeypatch.setattr(search, "table", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    p = spark.createDataFrame(prints, "id long, fingerprint long")
    got = search.similar_all(p, p.selectExpr("id as question", "fingerprint"), 12, 3).collect()
    want = {(q, r, i, d) for q, f in prints for r, (d, i) in enumerate(sorted((bin(f ^ g).count("1"), i) for i, g in prints)[:3], 1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(df.count() for name, df in written if name == "near") < 20 * len(prints)


@pytest.mark.parametrize("gathered", [100_000, 0])
def test_contracted_components(spark, monkeypatch, gathered):
    """Paths in order, a hub, loops, doubled and null ends, as numbers and as names; links shrink from round to round."""
    monkeypatch.setattr(iterate, "GATHERED", gathered, raising=False)
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(300) if i % 100] + [(-5, 1000 + i) for i in range(200)] + [(7, 7), (3000, 3000), (None, 4), (5, None), (2000, 2001), (2001, 2000)] + [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    sizes, write = [], iterate.table
    monkeypatch.setattr(iterate, "table", lambda df, name, *k: sizes.append((name, write(df, name, *k))) or sizes[-1][1])
    got = iterate.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(up) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in up}
    if not gathered:
        left = [df.count() for name, df in sizes if name == "edges"]
        assert len(left) > 2 and left[-1] == 0 and sum(left[1:]) < 2 * left[0]
    named = iterate.components(spark.createDataFrame([(None if a is None else f"n{a}", None if b is None else f"n{b}") for a, b in edges], "a string, b string")).collect()
    least = {}
    for x in up:
        least[find(x)] = min(least.get(find(x), "z"), f"n{x}")
    want = {f"n{x}": least[find(x)] for x in up}
    assert {r["node"]: r["root"] for r in named} == want


def test_stats_count_components_without_naming_them(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("f", None), (None, "b")], "source string, target string")
    pages = spark.createDataFrame([(x,) for x in "abgg"] + [(None,)], "page string")
    made, write = [], iterate.table
    monkeypatch.setattr(iterate, "table", lambda df, name, *k: made.append(name) or write(df, name, *k))
    assert graph.stats(edges, pages).first()["connected_components"] == 5  # a b, c, d e, g, and the page without a name
    assert "names" in made and "named" not in made


def test_a_first_epoch_meets_nothing(spark, monkeypatch, tmp_path):
    """Only links are looked for, a name has a row for each distinct key, and without a state little is written between."""
    texts = ["[[a b]] [[A-b|x]] `[[code]]` [[A-b]] ![[q#h]]", "plain", "[[d/c]]\n\n    [[code]]\n", "---\nx: [[y]]\n---\n[[z^b]]", "a <!-- [[w]] --> [[v]]\n~~~\n[[u]]\n~~~", "\t[[tab]]", "[[]] [[#top]]"]
    pages = [(p, t) for p, t in zip(["A-b.md", "c.md", "d/C.md", "e.md", "f.md", "g.md", "r.spl"], texts, strict=True)]
    v = vault.Vault(spark.createDataFrame(pages, "path string, content string"))
    want = v.links.groupBy("path", "source", "raw_target", "target_page").count()
    assert sorted(map(tuple, v.references.collect())) == sorted(map(tuple, want.collect())) and want.count() == 6
    made, write = [], vault_watch.table
    monkeypatch.setattr(vault_watch, "table", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(vault, "parse", None)
    seen = []
    w = vault_watch.VaultWatch(spark, lambda df, e: seen.extend(map(tuple, df.collect())), str(tmp_path), 4)
    w.batch(spark.createDataFrame([(*p, 1) for p in pages], "path string, content string, seq long"), 0)
    assert made == ["arrived", "added", "raws", "new-refs", "pairs", "ends"]
    assert w.tables.latest().read("keys").count() == 9 and ("dead_gained", "e", "z") in seen and ("link_added", "A-b", "A-b") in seen
    assert "Exchange" not in plan_of(w.edges.join(w.tables.none("pairs").select("target"), "target", "left_anti"))


def odd_docs(spark):
    docs = [(1, "a b A c"), (1, "b b"), (1, "a x y z"), (2, "a"), (3, None), (4, "--"), (None, "a q"), (5, "d a d"), (6, "Über über 7")]
    return docs, [(i, re.findall(r"[a-zü0-9]+", (t or "").lower())) for i, t in docs], lambda some: spark.createDataFrame(some, "id long, text string")


def test_postings_are_made_where_rows_lie(spark, tmp_path):
    """Ids that repeat or are null, with equal and other lengths: rows are counted without a shuffle and added up when asked for."""
    docs, words, put = odd_docs(spark)
    rows = sorted(((t, i, ts.count(t), len(ts)) for i, ts in words for t in set(ts)), key=repr)
    assert sorted(map(tuple, search.row_postings(put(docs), "id").collect()), key=repr) == rows and "Exchange" not in plan_of(search.row_postings(put(docs), "id"))
    export.build_index(put(docs), str(tmp_path), "id")
    score = lambda found: [(r["id"], round(r["score"], 9)) for r in found.collect()]
    assert score(export.query_index(spark, str(tmp_path), "a über")) == score(search.search(put(docs), "a über", id_col="id"))


def test_terms_are_counted_where_rows_lie(spark):
    """Documents are counted by their ids, which may repeat or be null; without repeats only terms are moved."""
    docs, words, put = odd_docs(spark)
    for some in (docs, docs[3:]):
        own = [(i, t) for (i, ts), d in zip(words, docs, strict=True) if d in some for t in ts]
        want = {t: (len({i for i, x in own if x == t and i is not None}), sum(x == t for _, x in own)) for _, t in own}
        got = search.term_counts(put(some), "id").collect()
        assert {r["term"]: (r["df"], r["n"]) for r in got} == want and len(got) == len(want)
    assert plan_of(search.term_counts(put(docs[3:]), "id")).count("Exchange hashpartitioning") == 1


def test_segments_count_terms_where_documents_lie(spark, monkeypatch, tmp_path):
    """Documents move once, by their range; of ids that repeat the smallest text counts, and null texts are documents."""
    docs = [(1, "b a b"), (2, None), (3, ""), (None, "a"), (4, "a"), (4, "A c c"), (4, None), (5, "--")]
    plans, ranged = [], segments.in_ranges
    monkeypatch.setattr(segments, "in_ranges", lambda df, order: plans.append(plan_of(df)) or ranged(df, order))
    index = segments.SegmentIndex(spark, str(tmp_path / "index"), "long")
    index.edit(0, spark.createDataFrame(docs, "id long, text string"))
    got = {r["id"]: (r["dl"], sorted(map(tuple, r["terms"]))) for r in spark.read.parquet(str(tmp_path / "index/docs/seg=0")).collect()}
    assert got == {1: (3, [("a", 1), ("b", 2)]), 2: (0, []), 3: (0, []), 4: (3, [("a", 1), ("c", 2)]), 5: (0, [])}
    spark.createDataFrame([(6, "a"), (1, "c a")], "id long, text string").write.parquet(str(tmp_path / "more"))
    index.edit(1, spark.read.parquet(str(tmp_path / "more")))
    assert "Exchange" not in plans[1] and (index.state()["n"], index.state()["length"]) == (6, 6)
    assert [r["id"] for r in index.top("a", 9).collect()] == [6, 1, 4]


def test_the_last_open_items_are_decided_in_one_task(spark, monkeypatch):
    """As the rounds would, and counting as many, without a table for each."""
    rng = random.Random(13)
    items = [(f"c{i // 2}", f"d{(i + 1) // 2}", None, i) for i in range(12)] + [(f"g{rng.randrange(40)}", f"l{rng.randrange(40)}", rng.choice(["", f"h{rng.randrange(60)}"]), 20 + i) for i in range(150)]
    rows = seen.ordered(spark.createDataFrame(items, "guid string, link string, hash string, seq long"))
    known = spark.createDataFrame([("guid", "g1"), ("link", "l2"), ("guid", "l3")], "kind string, value string")
    written, write, found = [], seen.table, []
    monkeypatch.setattr(seen, "table", lambda df, name: written.append(name) or write(df, name))
    for gathered in (0, 10**6):
        monkeypatch.setattr(seen, "GATHERED", gathered, raising=False)
        written.clear()
        new, rounds = seen.decide(rows, known)
        found.append((sorted(r[0] for r in new.collect()), rounds))
    assert found[0] == found[1] and found[0][1] > 3 and written == ["open", "lent"]
