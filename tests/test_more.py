"""Exports, whole searches, access by reasoning."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from quillgraph.logic.rules import Theory
from quillgraph.operators import access, export, find, predicate
from quillgraph.sources.vault import Vault

PAGES = [("Alpha.md", "# One\nquick fox\n## Two\nthe quick [[Beta]]"), ("notes/Beta.md", "quick\nquicker [[Alpha]] [[Nope]]"), ("notes/Gamma.md", "slow")]


def vault(spark):
    return Vault(spark.createDataFrame(PAGES, "path string, content string"))


def test_full_text(spark):
    v = vault(spark)
    hits = find.full_text(v.pages, v.headings, "quick").collect()
    assert {(h.path, h.line, h.heading) for h in hits} == {("Alpha.md", 2, "One"), ("Alpha.md", 4, "Two"), ("notes/Beta.md", 1, None), ("notes/Beta.md", 2, None)}
    assert {h.path for h in find.full_text(v.pages, v.headings, "quick", glob="notes/").collect()} == {"notes/Beta.md"}
    near = spark.createDataFrame([("Alpha",)], "node string")
    assert {h.page for h in find.full_text(v.pages, v.headings, "quick", near=near).collect()} == {"Alpha"}


def test_pages_by_name(spark):
    v = vault(spark)
    assert find.find_page(v.pages, "alpha").first()["page"] == "Alpha" and find.find_page(v.pages, "Gammo").first()["page"] == "Gamma"
    nodes, hints = find.around(v.edges, v.pages, "Alpha", 1)
    assert {r.node for r in nodes.collect()} == {"Alpha", "Beta"} and hints.count() == 1
    assert find.around(v.edges, v.pages, "Lph", 1)[0].count() == 0
    picks = {"h": predicate.selector(["notes/**"])}
    pages = v.pages.withColumn("parser", F.lit("table"))
    assert find.mixed_parsers(pages, picks, {"h": "markdown"}).count() == 2


def test_hybrid(spark):
    a = spark.createDataFrame([("x", 2.0), ("x", 1.0), ("y", 1.5)], "page string, score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.1)], "page string, score double")
    assert [r.page for r in find.hybrid(a, b).collect()] == ["y", "x", "z"]
    chunks = spark.createDataFrame([("p", None, 0, [1.0, 0.0]), ("q", "h", 1, [0.0, 1.0])], "page string, heading string, idx int, embedding array<float>")
    assert find.by_vector(chunks, [0.0, 1.0], 1).first()["page"] == "q"


def test_exports(spark, tmp_path):
    v = vault(spark)
    rows = [(r.part, json.loads(r.value)) for r in export.graph_json(v.edges, v.pages).collect()]
    assert [x for p, x in rows if p == "counts"] == [{"nodes": 4, "edges": 3}]
    assert sum(p == "edge" for p, _ in [(r.part, r.value) for r in export.index_json(v.edges, v.pages).collect()]) == 3
    seqs = spark.createDataFrame([(i,) for i in range(30)], "seq int")
    links = spark.createDataFrame([(i, "a", f"t{i}") for i in range(30)], "seq int, page string, target string")
    got = [(r.part, json.loads(r.value)) for r in export.history_json(seqs, links).collect()]
    assert sum(p == "vault" for p, _ in got) == 10 and [len(x["points"]) for p, x in got if p == "page"] == [10]
    export.build_index(v.pages.withColumnRenamed("content", "text"), str(tmp_path / "i"))
    assert [r.id for r in export.query_index(spark, str(tmp_path / "i"), "slow").collect()] == ["Gamma"] and export.query_index(spark, str(tmp_path / "i"), "").count() == 0
    export.write_json_lines(v.nodes, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    typed = spark.createDataFrame([("A", 2, ["x"]), ("A", 1, ["y", "x"])], "source string, line int, predicates array<string>")
    assert export.page_predicates(typed).first()["predicates"] == ["y", "x"]
    scopes = spark.createDataFrame([("n", "notes/"), ("z", "z/")], "scope string, prefix string")
    assert {(r.scope, r["items"]) for r in export.catalog(scopes, v.pages).collect()} == {("n", 2), ("z", 0)}


def test_access_by_reasoning(spark):
    users = spark.createDataFrame([("own", "reader", True, False), ("adm", "admin", False, False), ("bot", "admin", False, True), ("ed", "editor", False, False), ("rd", "reader", False, False)], "user string, role string, owner boolean, agent boolean")
    scopes = spark.createDataFrame([("ed", "^docs/"), ("rd", "^docs/")], "user string, pattern string")
    asks = spark.createDataFrame([(u, p, a) for u in ("own", "adm", "bot", "ed", "rd", "who") for p in ("docs/a", "access") for a in ("read", "edit")], "user string, page string, action string")
    rows = lambda df: sorted((r.user, r.page, r.action, r.allowed, r.tag) for r in df.collect())
    assert rows(access.evaluate(asks, users, scopes)) == rows(access.decide(asks, users, scopes))
    text = '(given (owner "who")) (given lock) (except p1 lock (not (can-edit "adm" "docs/a")))'
    policy = Theory.of_blocks(spark.createDataFrame([("a.spl", "a", 0, 1, text)], "path string, page string, ord int, start_line int, content string"))
    got = {(r.user, r.page, r.action): r.allowed for r in access.evaluate(asks, users, scopes, policy).collect()}
    assert not got["adm", "docs/a", "edit"] and got["adm", "access", "edit"] and not got["who", "docs/a", "edit"]


def test_comments(spark):
    key = b"k" * 70
    good = hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("héllo", good, "2024-02-01"), ("other", good, "2024-01-01"), (None, None, "2023-01-01")], "body string, hmac string, at string")
    assert [r.valid for r in access.verify_comments(df, key).orderBy(F.desc("at")).collect()] == [True, False, False]
    assert access.prune_comments(df, "2024-01-01").count() == 2
