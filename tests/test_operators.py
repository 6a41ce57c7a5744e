"""Search, history, hashes, feeds, access, predicates, merging, functions."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import dates, hashes, names
from quillgraph.operators import access, feed, history, hooks, html, merge, merkle, predicate, search

NOW = datetime(2024, 3, 13, 12, tzinfo=timezone.utc)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


DATA = '{"s": "abc", "n": 3, "f": 2.5, "b": true, "z": null, "list": [1, "two", {"k": 5}], "deep": {"x": {"y": "q"}}}'


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("s == 'abc'", True), ('s == "abd"', False), ("n == 3", True), ("n == 3.0", True), ("n == '3'", False), ("n != '3'", True), ("n > 2 && f < 3", True), ("s < 'abd'", True), ("s > 1", False), ("b", True), ("s", False), ("!b", False),
        ("z is null", True), ("nope is null", True), ("nope != 1", True), ("nope != null", False), ("nope == null", True), ("nope < 5", False), ("!(nope < 5)", True), ("list contains 'two'", True), ("list contains 2", False), ("s contains 'bc'", True),
        ("s matches '^a.c$'", True), ("n matches '3'", False), ("list[-1].k == 5", True), ("list[0] == 1", True), ("list[9] is null", True), ("deep.x.y == 'q' && !(n == 4 || s == 'x')", True), ("b == true || n == 9 && n == 8", True), ("s is not null", True), ("z == false", False),
    ],
)
def test_predicates(spark, source, want):
    df = spark.createDataFrame([(DATA,)], "j string")
    assert df.select(predicate.compile(source, F.col("j")).alias("x")).first()["x"] is want


@pytest.mark.parametrize("bad", ["", "n ==", "== 3", "n === 3", "(n == 3", "n == 3)", "n[x]", "n matches 3", "a b"])
def test_bad_predicates(bad):
    with pytest.raises(predicate.PredicateError):
        predicate.parse(bad)


def test_predicate_on_broken_json(spark):
    df = spark.createDataFrame([("not json",), (None,)], "j string")
    assert rows(df.select(predicate.compile("n == 3", F.col("j")).alias("a"), predicate.compile("n != 3", F.col("j")).alias("b"))) == [(False, True)] * 2


def test_selector(spark):
    df = spark.createDataFrame([("notes/a.md", '{"draft": false}', "hello TODO"), ("notes/b.md", '{"draft": true}', "TODO"), ("x/c.md", '{"draft": false}', "TODO")], "path string, frontmatter string, content string")
    assert rows(predicate.selector(["notes/**"], ["**/z*"], "draft == false", ["TODO", "re:^hel"], True)(df).select("path")) == [("notes/a.md",)]


def test_times():
    at = lambda s: dates.parse_time(s, NOW)
    assert at("HEAD~3") == ("offset", 3) and at("HEAD") == ("offset", 0) and at("abc123") == ("ref", "abc123")
    assert at("2024-01-02")[1] == datetime(2024, 1, 2, 23, 59, 59, tzinfo=timezone.utc)
    assert at("yesterday")[1].day == 12 and at("last wednesday")[1].day == 6 and at("last tuesday")[1].day == 12
    assert at("2 months ago")[1] == datetime(2024, 1, 13, 12, tzinfo=timezone.utc) and at("2024-01-02T03:04:05Z")[0] == "at"
    assert dates.retention("2mo") == ("seconds", 60 * 86400) and dates.retention("last-7") == ("count", 7) and dates.retention("Forever") == ("forever", 0)
    with pytest.raises(ValueError):
        dates.retention("soon")


def test_functions(spark):
    v = lambda c: value(spark, c)
    assert v(names.page_slug(F.lit("My Notes\\Big Note.md"))) == "my-notes/big-note" and v(names.page_name(F.lit("a/b.c.md"))) == "b.c"
    assert v(names.heading_slug(F.lit("  Hello, Wörld! 2 "))) == "hello-wörld-2" and v(names.link_fragment(F.lit("p#^id"))) == "" and v(names.link_fragment(F.lit("p#A b"))) == "#a-b"
    assert v(names.auto_label(F.lit("based_in"))) == "Based in" and v(names.auto_label(F.lit("prov:wasDerivedFrom"))) == "wasDerivedFrom"
    assert [v(names.glob(F.lit("a/b/c.md"), g)) for g in ("a/**/*.md", "*.md", "a/?.md", "**/c.{md,txt}", "[ab]/*", "[!a]*")] == [True, True, False, True, True, False]
    assert v(dates.humanise_days(F.lit(45))) == "1mo" and v(dates.minus_seconds(F.lit("2024-03-01T00:00:00Z"), 86400)) == "2024-02-29T00:00:00Z"
    assert v(dates.rfc822(F.lit("2024-03-01 00:00:00").cast("timestamp"))) == "Fri, 01 Mar 2024 00:00:00 +0000"
    assert [v(names.version_satisfies(F.lit(x), "^0.2.3")) for x in ("0.2.3", "0.2.9", "0.3.0")] == [True, True, False]
    assert [v(names.line_kind(F.lit(x))) for x in ("# a", "- [ ] t", "- b", "1. c", "> q", "```", "---", "x", "")] == ["heading", "task", "bullet", "ordered", "quote", "fence", "rule", "paragraph", "blank"]


def test_dates(spark):
    df = spark.createDataFrame([(" ", "2024-02-30", None), ("2024-02-29", None, None), (None, "2024-01-01T00:00:00", None), (None, None, "1969-01-01"), (None, "", None), ("2030-01-01T00:00:00Z", None, None)], "a string, b string, c string")
    at, source, error = dates.resolve_date([(n, F.col(n)) for n in "abc"], "2025-01-01T00:00:00Z")
    assert [tuple(r) for r in df.select(at, source, error).collect()] == [(None, "b", "malformed"), ("2024-02-29T00:00:00Z", "a", None), (None, "b", "malformed"), (None, "c", "malformed"), (None, None, "missing"), (None, "a", "malformed")]


def test_fingerprint_of_texts(spark):
    one = hashes.fingerprint_of
    assert one("") == 0 and one("Hello, World") == one("hello world") == one("hello-world") and one("kitten") != one("mitten")
    df = spark.createDataFrame([("a", "graph database"), ("b", "graph databases"), ("c", "cooking pasta")], "page string, text string")
    assert search.similar(search.fingerprints(df), "graph database").first()["id"] == "a"


def test_search(spark):
    docs = spark.createDataFrame([("Alpha", "the quick brown fox\nanother line"), ("Beta", "quick quick fox"), ("Gamma", "slow")], "page string, text string")
    assert [r.id for r in search.search(docs, "QUICK").collect()] == ["Beta", "Alpha"]
    assert search.search(docs, "").count() == 0
    hits = search.line_matches(docs, "qui fox")
    assert {(r.id, r.line) for r in hits.collect()} == {("Alpha", 1), ("Beta", 1)}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "page string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "page string, rank int")
    assert rows(search.fuse_ranks(a, b)) == rows(search.fuse_ranks(b, a)) and search.fuse_ranks(a, b).orderBy(F.desc("score")).first()["page"] == "y"


def test_history(spark):
    seqs = spark.createDataFrame([(i,) for i in range(4)], "seq int")
    links = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "b", None), (3, "a", "y")], "seq int, page string, target string")
    got = {r.seq: r for r in history.vault_history(seqs, links).collect()}
    assert (got[1].pages_added, got[1].links_added, got[2].pages_removed, got[2].links_removed, got[3].links_added) == (1, 1, 2, 2, 1)
    events = [(r.page, r.seq, r.event) for r in history.page_history(seqs, links).orderBy("page", "seq").collect()]
    assert events == [("a", 0, "appeared"), ("a", 1, "changed"), ("a", 2, "disappeared"), ("a", 3, "appeared"), ("b", 1, "appeared"), ("b", 2, "disappeared")]
    line = spark.createDataFrame([(1, "h"), (2, None), (3, "h"), (4, None), (5, "k")], "ts int, vault_root_hash string")
    assert sorted(r.ts for r in history.collapse(line).collect()) == [2, 3, 4, 5]
    snaps = spark.createDataFrame([("c1", datetime(2024, 1, 1)), ("c2", datetime(2024, 2, 1)), ("d3", datetime(2024, 3, 1))], "change_id string, ts timestamp")
    ask = lambda s: [r.change_id for r in history.resolve_snapshot(snaps, s, NOW).collect()]
    assert ask("2024-02-01") == ["c2"] and ask("HEAD~2") == ["c1"] and ask("d") == ["d3"] and ask("c") == [] and ask("2020-01-01") == []
    assert [r.seq for r in history.sample_trend(seqs, 2).orderBy("seq").collect()] == [0, 3] and history.sample_trend(seqs, 9).count() == 4


def test_objects(spark):
    o = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "1"), ("d", "p", "1")], "object_id string, path string, hash string")
    n = spark.createDataFrame([("a", "q", "2"), ("b", "p", "2"), ("c", "p", "1"), ("e", "p", "1")], "object_id string, path string, hash string")
    assert [tuple(r) for r in history.object_changes(o, n, 7).orderBy("seq").select("seq", "object_id", "change").collect()] == [(7, "a", "moved"), (8, "b", "updated"), (9, "e", "added"), (10, "d", "deleted")]


def test_references(spark):
    leaves = spark.createDataFrame([("A.md", 0, "b1", "aaaaaaaa11"), ("A.md", 1, "b1", "bbbbbbbb11"), ("B.md", 0, None, "bbbbbbbb22")], "path string, pos int, block_id string, hash string")
    pages = spark.createDataFrame([("A", "A.md"), ("B", "B.md")], "page string, path string")
    refs = spark.createDataFrame([("A.md", "^b1"), ("B.md", "^b1"), ("B.md", "[[A^b1]]"), ("B.md", "[[A]]"), ("B.md", "[[Z]]"), ("B.md", "aaaaaaaa"), ("B.md", "bbbbbbbb"), ("B.md", "hm")], "path string, ref string")
    got = {(r.path, r.ref): (r["class"], r.ok) for r in merkle.check_references(refs, leaves, pages).collect()}
    assert got == {("A.md", "^b1"): ("local", True), ("B.md", "^b1"): ("local", False), ("B.md", "[[A^b1]]"): ("cross_file", True), ("B.md", "[[A]]"): ("page", True), ("B.md", "[[Z]]"): ("page", False), ("B.md", "aaaaaaaa"): ("hash", True), ("B.md", "bbbbbbbb"): ("hash", False), ("B.md", "hm"): ("unknown", False)}
    declared = spark.createDataFrame([("B.md", 3, "A.md", "b1", "aaaaaaaa11"), ("B.md", 4, "A.md", "b1", "old"), ("B.md", 5, "A.md", "zz", "x")], "path string, line int, target_path string, block_id string, hash string")
    assert rows(merkle.explicit_drift(declared, leaves).select("line", "drift")) == [(4, "changed"), (5, "missing")]


def test_feeds(spark):
    items = spark.createDataFrame([("i1", "u", "T & t", "s", "2024-01-02T00:00:00Z", ["a"]), ("i2", "u", "T", "s", "2024-01-03T00:00:00Z", [])], "id string, url string, title string, summary string, date_published string, tags array<string>")
    assert "T &amp; t" in feed.rss(items, "F", "http://x") and feed.atom(items, "F", "http://x").count("<entry>") == 2 and '"items"' in feed.json_feed(items, "F", "http://x")


def test_access(spark):
    users = spark.createDataFrame([("own", "reader", True, False), ("adm", "admin", False, False), ("bot", "admin", False, True), ("ed", "editor", False, False)], "user string, role string, owner boolean, agent boolean")
    scopes = spark.createDataFrame([("ed", "^docs/")], "user string, pattern string")
    asks = spark.createDataFrame([(u, p, "edit") for u in ("own", "adm", "bot", "ed", "who") for p in ("docs/a", "access")] + [("who", "x", "read")], "user string, page string, action string")
    ok = {(r.user, r.page) for r in access.decide(asks, users, scopes).collect() if r.allowed}
    assert ok == {("own", "docs/a"), ("own", "access"), ("adm", "docs/a"), ("adm", "access"), ("bot", "docs/a"), ("ed", "docs/a"), ("who", "x")}
    times = spark.createDataFrame([("a", 10, 20), ("b", 20, 30), ("c", 21, 30), ("d", 1, 20)], "literal string, start long, end long")
    assert {(r.literal, r.relation) for r in access.temporal_facts(times, 20).collect()} == {("a", "finishes"), ("b", "meets"), ("d", "finishes")}


def test_merging(spark):
    n = lambda k: spark.range(1, k + 1).select(F.col("id").alias("ms"))
    assert [n(k).agg(merge.nearest_rank("ms", 0.95).alias("p")).first()["p"] for k in (20, 3, 0)] == [19, 3, 0]
    gates = html.fetch_gates(spark.createDataFrame([("http://a.org", "x"), ("file:///x", "<!DOCTYPE a>"), ("http://127.0.0.1/", "")], "url string, body string")).collect()
    assert [(g.safe_scheme, g.public_target, g.no_entities) for g in gates] == [(True, True, True), (False, False, False), (True, False, True)]


def test_hooks(spark):
    pages = spark.createDataFrame([("a", '{"type": "doc"}', '{"x.off": false}'), ("b", '{"type": "doc"}', None)], "path string, content string, frontmatter string")

    def tag(tree, page):
        page.emit("k", page.path)
        return {**tree, "seen": True}

    def broken(tree, page):
        raise KeyError

    got = {r.path: r for r in hooks.run_stage(pages, [hooks.Hook("broken", "transform", broken), hooks.Hook("tag", "transform", tag, "x.off")], "transform").collect()}
    assert got["a"].ran == [] and got["a"].failed == ["broken"] and got["b"].ran == ["tag"] and '"seen": true' in got["b"].content and got["b"].emitted[0].value == '"b"'
