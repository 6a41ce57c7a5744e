"""Graph operators on small hand-made graphs."""

import pytest

from quillgraph.operators import graph, iterate, lint, rdf
from quillgraph.operators.lint import Vocabulary

PAGES = [("Index", "Index.md"), ("Page A", "notes/Page A.md"), ("Page B", "notes/Page B.md"), ("Page C", "Page C.md"), ("Alone", "x/Alone.md")]
EDGES = [("Index", "Page A", None, None, 1), ("Index", "Page B", "supports", "why", 2), ("Index", "Page B", "cites", "why", 2), ("Page A", "Ghost", None, None, 3), ("Page B", "Page C", "ex:partOf", None, 1), ("Page C", "Page C", None, None, 9), ("Page C", "Page A", None, None, 2)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(EDGES, "source string, target string, predicate string, annotation string, line int"), spark.createDataFrame(PAGES, "page string, path string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_basics(g):
    e, p = g
    assert rows(graph.dead_links(e, p).select("source", "target")) == [("Page A", "Ghost")]
    assert rows(graph.orphans(e, p)) == [("Alone", 0), ("Index", 3)]
    assert [tuple(r) for r in graph.most_linked(e, 2).collect()] == [("Page A", 2), ("Page B", 2)]
    assert [tuple(r) for r in graph.by_predicate(e).collect()][0] == (None, 4)
    s = graph.stats(e, p).collect()[0]
    assert (s.total_pages, s.total_links, s.unique_targets, s.dead_links, s.orphan_count, s.connected_components) == (5, 7, 4, 1, 2, 2)
    assert [x.page for x in s.most_linked][:2] == ["Page A", "Page B"]
    assert rows(graph.backlink_groups(e, "Page B")) == [("Index", 2, 2, "cites")]
    assert rows(graph.edge_filter(e, annotated=True, predicates=["cites"], source="INDEX").select("target")) == [("Page B",)]
    assert len(rows(graph.index_edges(e, True))) == 7 and len(rows(graph.index_edges(e, False))) == 6
    assert rows(graph.folder_rollup(p)) == [("notes", 2), ("x", 1)]
    assert rows(graph.did_you_mean(p, "page")) == [("Page A",), ("Page B",), ("Page C",)]


def test_rounds(g, spark):
    e, p = g
    assert dict(rows(iterate.neighbourhood(e, "Page A", 1))) == {"Page A": 0, "Index": 1, "Ghost": 1, "Page C": 1}
    assert rows(iterate.shortest_path(e, "Index", "Page C")) == [(2, ["Index", "Page B", "Page C"])]
    assert rows(iterate.shortest_path(e, "Page A", "Index")) == [] and rows(iterate.shortest_path(e, "x", "x")) == [(0, ["x"])]
    assert rows(iterate.linked_within(e, "Index", 2)) == [("Index", "Page A", 1, 1), ("Index", "Page B", 2, 1), ("Page A", "Ghost", 3, 2), ("Page B", "Page C", 1, 2)]
    assert {r[0] for r in rows(iterate.components(e, "source", "target"))} == {"Index", "Page A", "Page B", "Page C", "Ghost"}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in iterate.components(chain).collect()} == {0}
    flipped = chain.selectExpr("b as a", "a as b")
    assert rows(iterate.components(chain)) == rows(iterate.components(flipped))
    assert iterate.components(chain.limit(0)).count() == 0


def test_diff_of_a_graph_with_itself_is_empty(g):
    e, p = g
    assert rows(graph.graph_diff(e, p, e, p)) == []
    later = e.filter("target <> 'Ghost' and predicate is null or predicate = 'supports'")
    got = {(r[0], r[1], r[2]) for r in rows(graph.graph_diff(e, p, later, p))}
    assert ("link_removed", "Page A", "Ghost") in got and ("dead_resolved", "Page A", "Ghost") in got


def test_names(spark):
    pages = spark.createDataFrame([("Big Note", "a/Big Note.md"), ("big note", "b/big note.md"), ("one-two", "one-two.md"), ("Sub", "dir/Sub.md")], "page string, path string")
    asks = [("big note", "Big NOTE"), ("One Two", "One Two"), ("dir/sub", "dir/sub"), ("DIR/SUB", "DIR/SUB"), ("nothing", "nothing"), ("x/one-two", "x/one-two")]
    links = spark.createDataFrame(asks, "raw_target string, target_page string")
    assert dict(rows(graph.resolve_names(links, pages).select("raw_target", "resolved"))) == {"big note": None, "One Two": "one-two", "dir/sub": "Sub", "DIR/SUB": "Sub", "nothing": None, "x/one-two": None}


def test_edges_of_links(spark):
    pages = spark.createDataFrame([("A", "A.md"), ("B", "B.md")], "page string, path string")
    links = spark.createDataFrame([("A", "b", "b", ["x", "y"], 1), ("A", "#h", "", [], 2), ("A", "^id", "", [], 3), ("A", "Gone", "Gone", [], 4)], "source string, raw_target string, target_page string, predicates array<string>, line int")
    got = {(r.target, r.predicate, r.line, r.is_ghost) for r in graph.build_edges(links, pages).collect()}
    assert got == {("B", "x", 1, False), ("B", "y", 1, False), ("A", None, 2, False), ("", None, 3, True), ("Gone", None, 4, True)}


def test_lints(spark):
    uses = [("f1", i, "supports") for i in range(10)] + [("f2", 3, "suports"), ("f2", 4, "relates_to"), ("f2", 5, "relates_to"), ("f3", 1, "is_a"), ("f3", 2, "zz:thing")]
    df = spark.createDataFrame(uses, "file string, line int, predicate string")
    kinds = [(r.kind, r.file, r.line, r.level) for r in lint.lints(df, Vocabulary(labels={"supports": None, "relates_to": None, "is_a": None}, prefixes={}, enforce=True)).collect()]
    assert ("predicate-drift", "f2", 3, "warning") in kinds and ("predicate-undeclared", "f2", 3, "error") in kinds
    assert ("predicate-relates-to-overuse", "f2", 4, "info") in kinds and ("predicate-undeclared-prefix", "f3", 2, "info") in kinds
    assert ("predicate-prefer-conforms-to", "f3", 1, "warning") in kinds
    near = {r.predicate: r.near for r in lint.nearest_declared(df, ["supports", "suppurt"]).collect()}
    assert near["suports"] == "supports" and near["zz:thing"] is None


def test_vocabulary_file():
    v = Vocabulary.from_toml('enforce = true\n[prefixes]\nex = "http://e/"\n[predicates.cites]\nlabel = "Cites"\nmaps_to = "ex:c"\nstate = "stable"\n')
    assert v.enforce and v.labels == {"cites": "Cites"} and v.maps_to == {"cites": "ex:c"} and v.states == {"cites": "stable"}


def test_rdf(g):
    e, p = g
    found = rdf.triples(e, p, "http://v/", Vocabulary(prefixes={"ex": "http://ex/"}))
    lines = [r.value for r in rdf.ntriples(found).collect()]
    assert "<http://v/page/Page%20B> <http://ex/partOf> <http://v/page/Page%20C> ." in lines
    assert any("\"why\"" in x for x in lines)
    assert any(x.value.startswith("<http://v/page/Index>") for x in rdf.turtle(found).collect())
    import json

    assert all("@id" in json.loads(r.value) for r in rdf.jsonld(found).collect())
