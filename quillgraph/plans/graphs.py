"""Queries over the derived link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, iterate, lint, rdf
from ..sources.vault import Vault, choose_parser
from . import model
from .registry import ORACLES, query

G = model.GRAPH


_W = "w AS MATERIALIZED (SELECT source AS a, target AS b FROM edges_ UNION SELECT target, source FROM edges_)"
#: The smallest node that each node reaches, either way, as roots(node, root).
_CC = f"""{_W}, cc(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM w UNION
    (SELECT u.node, t.root FROM (SELECT w.b AS node, min(v.root) AS root FROM cc v JOIN w ON w.a = v.node GROUP BY 1) t JOIN recurring.cc u ON u.node = t.node WHERE t.root < u.root)), roots AS (SELECT node, root FROM cc)"""


@query("graph_stats", f"""WITH RECURSIVE {G}, {_CC} SELECT (SELECT count(DISTINCT page) FROM pages_) AS total_pages, count(*) AS total_links, count(DISTINCT target) AS unique_targets,
    count(*) FILTER (WHERE target NOT IN (SELECT page FROM pages_)) AS dead_links, 0 AS ambiguous_links,
    (SELECT count(DISTINCT page) FROM pages_ WHERE page NOT IN (SELECT target FROM edges_)) AS orphan_count,
    (SELECT count(DISTINCT root) FROM roots) + (SELECT count(DISTINCT page) FROM pages_ WHERE page NOT IN (SELECT node FROM roots)) AS connected_components,
    (SELECT string_agg(target || ' ' || n, ', ' ORDER BY n DESC, target) FROM (SELECT target, count(*) AS n FROM edges_ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS most_linked FROM edges_""")
def graph_stats(s, d):
    told = F.array_join(F.transform("most_linked", lambda x: F.concat_ws(" ", x["page"], x["backlink_count"].cast("string"))), ", ")
    return graph.stats(model.edges(s, d), model.pages(s, d)).withColumn("most_linked", told)


@query("list_pages", f"WITH {G} SELECT page, path FROM pages_ ORDER BY lower(page)")
def list_pages(s, d):
    return model.pages(s, d).select("page", "path").orderBy(F.lower("page"))


@query("all_edges", f"WITH {G} SELECT source, target, predicate, annotation, line, target NOT IN (SELECT page FROM pages_) AS is_ghost FROM edges_")
def all_edges(s, d):
    return graph.with_ghosts(model.edges(s, d), model.pages(s, d))


@query("dead_links", f"WITH {G} SELECT * FROM edges_ WHERE target NOT IN (SELECT page FROM pages_)")
def dead_links(s, d):
    return graph.dead_links(model.edges(s, d), model.pages(s, d))


@query("orphans", f"""WITH {G}, o AS (SELECT source, count(*) AS n FROM edges_ GROUP BY 1) SELECT page, coalesce(n, 0) AS out_links FROM (SELECT DISTINCT page FROM pages_) p LEFT JOIN o ON o.source = p.page
    WHERE page NOT IN (SELECT target FROM edges_)""")
def orphans(s, d):
    return graph.orphans(model.edges(s, d), model.pages(s, d))


@query("by_predicate", f"WITH {G} SELECT predicate, count(*) AS n FROM edges_ GROUP BY 1")
def by_predicate(s, d):
    return graph.by_predicate(model.edges(s, d))


@query("most_linked", f"WITH {G} SELECT target AS page, count(*) AS backlink_count FROM edges_ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_linked(s, d):
    return graph.most_linked(model.edges(s, d))


@query("degrees", f"""WITH {G} SELECT p.page, (SELECT count(*) FROM edges_ e WHERE e.source = p.page) AS out_links, (SELECT count(*) FROM edges_ e WHERE e.target = p.page) AS backlinks,
    (SELECT count(*) FROM edges_ e WHERE e.source = p.page AND e.target NOT IN (SELECT page FROM pages_)) AS dead_links FROM (SELECT DISTINCT page FROM pages_) p""")
def degrees(s, d):
    return graph.degrees(model.edges(s, d), model.pages(s, d))


@query("edge_filter", f"WITH {G} SELECT * FROM edges_ WHERE predicate IN ('contains', 'placed_by') AND annotation IS NOT NULL")
def edge_filter(s, d):
    return graph.edge_filter(model.edges(s, d), predicates=["contains", "placed_by"], annotated=True)


@query("edge_filter_untyped", f"WITH {G} SELECT * FROM edges_ WHERE predicate IS NULL AND lower(target) = 'nation:3'")
def edge_filter_untyped(s, d):
    return graph.edge_filter(model.edges(s, d), untyped=True, target="Nation:3")


@query("forward_links", f"WITH {G} SELECT * FROM edges_ WHERE source = 'order:7'")
def forward_links(s, d):
    return graph.forward_links(model.edges(s, d), "order:7")


@query("backlinks", f"WITH {G} SELECT * FROM edges_ WHERE target = 'supplier:3'")
def backlinks(s, d):
    return graph.backlinks(model.edges(s, d), "supplier:3")


@query("backlink_groups", f"WITH {G} SELECT source, count(*) AS n, min(line) AS first_line, arg_min(predicate, line) FILTER (WHERE predicate IS NOT NULL) AS predicate FROM edges_ WHERE target = 'nation:3' GROUP BY 1")
def backlink_groups(s, d):
    return graph.backlink_groups(model.edges(s, d), "nation:3")


@query("predicate_groups", f"WITH {G} SELECT coalesce(predicate, '__untyped') AS predicate, list_sort(list(DISTINCT target)) AS pages FROM edges_ WHERE source IN ('supplier:3') GROUP BY 1")
def predicate_groups(s, d):
    return graph.predicate_groups(model.edges(s, d), "supplier:3")


@query("folder_rollup", f"WITH {G} SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM pages_ WHERE contains(path, '/') GROUP BY 1")
def folder_rollup(s, d):
    return graph.folder_rollup(model.pages(s, d))


@query("folder_tree", f"WITH {G} SELECT split_part(path, '/', 1) AS folder, 1 AS depth, count(*) AS n_pages, count(*) AS n_direct FROM pages_ GROUP BY 1")
def folder_tree(s, d):
    return graph.folder_tree(model.pages(s, d))


@query("tag_cloud", "SELECT tag, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, trim(unnest([source, lang, ' ' || lang || ' ', ''])) AS tag FROM documents) WHERE tag <> '' GROUP BY 1")
def tag_cloud(s, d):
    docs = model.read(s, d, "documents")
    return graph.tag_cloud(docs.select(F.col("doc_id").alias("slug"), F.explode(F.array("source", "lang", F.concat(F.lit(" "), "lang", F.lit(" ")), F.lit(""))).alias("tag")))


@query("export_edges", f"WITH {G} SELECT DISTINCT source, target FROM edges_")
def export_edges(s, d):
    return graph.export_graph(model.edges(s, d), model.pages(s, d))[1]


@query("export_nodes", f"WITH {G}, every AS (SELECT page FROM pages_ UNION SELECT source FROM edges_ UNION SELECT target FROM edges_) SELECT e.page, min(p.path) AS path FROM every e LEFT JOIN pages_ p ON p.page = e.page GROUP BY 1")
def export_nodes(s, d):
    return graph.export_graph(model.edges(s, d), model.pages(s, d))[0]


@query("index_edges_typed", f"""WITH {G} SELECT source || '--' || target || '--' || coalesce(predicate, '') AS key, source, target, predicate, line FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target, predicate ORDER BY line) AS k FROM edges_) WHERE k = 1""")
def index_edges_typed(s, d):
    return graph.index_edges(model.edges(s, d), True)


@query("index_edges_untyped", f"""WITH {G} SELECT source || '->' || target AS key, source, target, predicate, line FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY line, predicate NULLS FIRST) AS k FROM edges_) WHERE k = 1""")
def index_edges_untyped(s, d):
    return graph.index_edges(model.edges(s, d), False)


@query("index_nodes", f"""WITH {G}, o AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE target NOT IN (SELECT page FROM pages_)) AS dead FROM edges_ GROUP BY 1), b AS (SELECT target, count(*) AS n FROM edges_ GROUP BY 1)
    SELECT p.page, coalesce(o.n, 0) AS outgoing, coalesce(b.n, 0) AS backlinks, b.n IS NULL AS is_orphan, coalesce(o.dead, 0) > 0 AS has_dead_links FROM (SELECT DISTINCT page FROM pages_) p LEFT JOIN o ON o.source = p.page LEFT JOIN b ON b.target = p.page""")
def index_nodes(s, d):
    return graph.index_nodes(model.edges(s, d), model.pages(s, d))


@query("did_you_mean", f"WITH {G} SELECT DISTINCT page FROM pages_ WHERE contains(lower(page), 'nation:1') OR contains('nation:1', lower(page)) ORDER BY 1 LIMIT 5")
def did_you_mean(s, d):
    return graph.did_you_mean(model.pages(s, d), "Nation:1")


@query("components", f"WITH RECURSIVE {G}, {_CC} SELECT node, root FROM roots")
def components(s, d):
    return iterate.components(model.edges(s, d), "source", "target")


def _near(start: str, depth: int) -> str:
    return f"r(node, depth) AS (SELECT '{start}', 0 UNION SELECT w.b, r.depth + 1 FROM r JOIN w ON w.a = r.node WHERE r.depth < {depth})"


@query("neighbourhood", f"WITH RECURSIVE {G}, {_W}, {_near('supplier:3', 3)} SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def neighbourhood(s, d):
    return iterate.neighbourhood(model.edges(s, d), "supplier:3", 3)


@query("induced_subgraph", f"WITH RECURSIVE {G}, {_W}, {_near('nation:3', 2)} SELECT source, target, predicate, line FROM edges_ WHERE source IN (SELECT node FROM r) AND target IN (SELECT node FROM r)")
def induced_subgraph(s, d):
    e = model.edges(s, d)
    return iterate.induced(e, iterate.neighbourhood(e, "nation:3", 2)).select("source", "target", "predicate", "line")


@query("links_depth", f"""WITH RECURSIVE {G}, r(node, depth) AS (SELECT 'order:7', 0 UNION SELECT e.target, r.depth + 1 FROM r JOIN edges_ e ON e.source = r.node WHERE r.depth < 2)
    SELECT source, target, line, min(depth) + 1 AS hop FROM edges_ e JOIN r ON r.node = e.source GROUP BY 1, 2, 3""")
def links_depth(s, d):
    return iterate.linked_within(model.edges(s, d), "order:7", 3)


@query("backlinks_depth", f"""WITH RECURSIVE {G}, r(node, depth) AS (SELECT 'region:1', 0 UNION SELECT e.source, r.depth + 1 FROM r JOIN edges_ e ON e.target = r.node WHERE r.depth < 1)
    SELECT source, target, line, min(depth) + 1 AS hop FROM edges_ e JOIN r ON r.node = e.target GROUP BY 1, 2, 3""")
def backlinks_depth(s, d):
    return iterate.linked_within(model.edges(s, d), "region:1", 2, backwards=True)


@query("shortest_path", f"""WITH RECURSIVE {G}, e AS (SELECT DISTINCT source, target FROM edges_), r(node, depth, path) AS (SELECT 'order:7', 0, 'order:7' UNION ALL
    (SELECT e.target, min(r.depth) + 1, min(r.path || ' ' || e.target) FROM r JOIN e ON e.source = r.node WHERE r.depth < 6 GROUP BY 1))
    SELECT depth AS hops, path FROM r WHERE node = 'region:0' ORDER BY depth LIMIT 1""")
def shortest_path(s, d):
    return iterate.shortest_path(model.edges(s, d), "order:7", "region:0", 6).select("hops", F.array_join("path", " ").alias("path"))


@query("closure", f"""WITH RECURSIVE {G}, p AS (SELECT DISTINCT source, target FROM edges_), r(source, target, hops) AS (SELECT source, target, 1 FROM p UNION SELECT r.source, p.target, r.hops + 1 FROM r JOIN p ON p.source = r.target WHERE r.hops < 3)
    SELECT source, target, min(hops) AS hops FROM r GROUP BY 1, 2""")
def closure(s, d):
    return iterate.closure(model.edges(s, d), 3)


@query("check_summary", f"""WITH {G} SELECT 'dead_link' AS kind, 'error' AS level, count(*) AS n FROM edges_ WHERE target NOT IN (SELECT page FROM pages_)
    UNION ALL SELECT 'orphan', 'error', count(DISTINCT page) FROM pages_ WHERE page NOT IN (SELECT target FROM edges_) UNION ALL SELECT 'big_order', 'warning', count(*) FROM orders WHERE o_totalprice > 300000 HAVING count(*) > 0""")
def check_summary(s, d):
    found = model.read(s, d, "orders").filter("o_totalprice > 300000").select(F.lit("big_order").alias("kind"), F.lit("warning").alias("level"))
    return graph.check_summary(model.edges(s, d), model.pages(s, d), found)


def _markdown(s, d):
    """A Markdown page for each nation and region, with typed links as list items."""
    n, r = model.read(s, d, "nation"), model.read(s, d, "region")
    link = F.concat(F.lit("# "), "n_name", F.lit("\n\n- located_in::[["), "r_name", F.lit("]]\n  - as of 2024\n\nSee [["), "r_name", F.lit("#Notes|there]] and `[[code]]`.\n\n```\n[[fenced]]\n```\n"))
    geo = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("geo/"), "n_name", F.lit(".md")).alias("path"), link.alias("content"))
    return geo.unionByName(r.select(F.concat(F.lit("region/"), "r_name", F.lit(".md")).alias("path"), F.concat(F.lit("---\ntags: [place, "), "r_name", F.lit("]\nrank: "), F.col("r_regionkey").cast("string"), F.lit("\n---\n# "), "r_name", F.lit("\n\n## Notes\n\nText ^note\n")).alias("content")))


@query("markdown_round_trip", """SELECT n_name AS source, r_name AS target, 'located_in' AS predicate, 'as of 2024' AS annotation, 3 AS line, NULL AS heading, NULL AS alias, false AS is_ghost FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, r_name, NULL, NULL, 6, 'Notes', 'there', false FROM nation JOIN region ON n_regionkey = r_regionkey""")
def markdown_round_trip(s, d):
    return Vault(_markdown(s, d)).edges.select("source", "target", "predicate", "annotation", "line", "heading", "alias", "is_ghost")


@query("markdown_headings", "SELECT 'geo/' || n_name || '.md' AS path, 1 AS line, 1 AS level, n_name AS text FROM nation UNION ALL SELECT 'region/' || r_name || '.md', 5, 1, r_name FROM region UNION ALL SELECT 'region/' || r_name || '.md', 7, 2, 'Notes' FROM region")
def markdown_headings(s, d):
    return Vault(_markdown(s, d)).headings.select("path", "line", "level", "text")


@query("markdown_tags", "SELECT replace(lower('region/' || r_name), ' ', '-') AS slug, unnest(['place', r_name]) AS tag FROM region")
def markdown_tags(s, d):
    return Vault(_markdown(s, d)).tags


@query("markdown_leaves", """SELECT 'geo/' || n_name || '.md' AS path, unnest([0, 1, 2, 3]) AS pos, unnest(['heading', 'list', 'paragraph', 'code']) AS type, NULL AS block_id FROM nation
    UNION ALL SELECT 'region/' || r_name || '.md', unnest([0, 1, 2, 3]), unnest(['frontmatter', 'heading', 'heading', 'paragraph']), unnest([NULL, NULL, NULL, 'note']) FROM region""")
def markdown_leaves(s, d):
    return Vault(_markdown(s, d)).leaves.select("path", "pos", "type", "block_id")


@query("parser_choice", "SELECT page, CASE WHEN page LIKE 'part/%' THEN 'table' WHEN page LIKE 'order/1%' THEN 'ledger' ELSE 'markdown' END AS parser FROM (SELECT 'part/' || p_partkey AS page FROM part UNION ALL SELECT 'order/' || o_orderkey FROM orders)")
def parser_choice(s, d):
    p = model.read(s, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path")).unionByName(model.read(s, d, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path")))
    return choose_parser(p.withColumn("frontmatter", F.lit("{}")), [("part/**", "table"), ("order/1*", "ledger")], "markdown").select(F.col("path").alias("page"), "parser")


@query("resolve_names", """WITH p AS (SELECT n_name AS page, 'geo/' || n_name || '.md' AS path FROM nation UNION ALL SELECT r_name, 'region/' || r_name || '.md' FROM region),
    l AS (SELECT unnest([lower(n_name), replace(n_name, '_', '-'), 'GEO/' || n_name, n_name || 'x']) AS raw_target FROM nation)
    SELECT raw_target, coalesce((SELECT CASE WHEN count(*) = 1 THEN min(page) END FROM p WHERE lower(page) = lower(raw_target)), (SELECT CASE WHEN count(*) = 1 THEN min(page) END FROM p WHERE translate(lower(page), '-_', '  ') = translate(lower(raw_target), '-_', '  ')),
        (SELECT CASE WHEN count(*) = 1 THEN min(page) END FROM p WHERE contains(raw_target, '/') AND lower(replace(path, '.md', '')) = lower(raw_target))) AS resolved FROM l""")
def resolve_names(s, d):
    n, r = model.read(s, d, "nation"), model.read(s, d, "region")
    pages = n.select(F.col("n_name").alias("page"), F.concat(F.lit("geo/"), "n_name", F.lit(".md")).alias("path")).unionByName(r.select(F.col("r_name").alias("page"), F.concat(F.lit("region/"), "r_name", F.lit(".md")).alias("path")))
    raw = n.select(F.explode(F.array(F.lower("n_name"), F.replace("n_name", F.lit("_"), F.lit("-")), F.concat(F.lit("GEO/"), "n_name"), F.concat("n_name", F.lit("x")))).alias("raw_target"))
    return graph.resolve_names(raw.withColumn("target_page", F.col("raw_target")), pages).select("raw_target", "resolved")


VOCABULARY = lint.Vocabulary(labels={"based_in": "Based in", "located_in": None}, maps_to={"located_in": "geo:within"}, prefixes={"geo": "http://example.org/geo#"})
_B = "http://example.org/v/"


@query("rdf_triples", f"""WITH {model.GRAPH}, e AS (SELECT *, row_number() OVER (ORDER BY source, target, predicate NULLS FIRST, line, annotation NULLS FIRST) - 1 AS i FROM edges_),
    t AS (SELECT '{_B}page/' || replace(source, ':', '%3A') AS s, CASE predicate WHEN 'located_in' THEN 'http://example.org/geo#within' ELSE '{_B}predicate/' || predicate END AS p, '{_B}page/' || replace(target, ':', '%3A') AS o, '{_B}statement/' || i AS st, e.*, (SELECT min(path) FROM pages_ WHERE page = source) AS path FROM e WHERE predicate IS NOT NULL)
    SELECT s, p, o, 'iri' AS o_kind FROM t UNION SELECT st, '{rdf.RDF}type', '{rdf.RDF}Statement', 'iri' FROM t UNION SELECT st, '{rdf.RDF}subject', s, 'iri' FROM t UNION SELECT st, '{rdf.RDF}predicate', p, 'iri' FROM t UNION SELECT st, '{rdf.RDF}object', o, 'iri' FROM t
    UNION SELECT st, '{rdf.PROV}wasAttributedTo', s, 'iri' FROM t UNION SELECT st, '{rdf.DCTERMS}source', path || ':' || line, 'literal' FROM t UNION SELECT '{_B}vocabulary', '{rdf.RDF}type', '{rdf.SKOS}ConceptScheme', 'iri'
    UNION SELECT p, '{rdf.RDF}type', '{rdf.SKOS}Concept', 'iri' FROM t UNION SELECT p, '{rdf.SKOS}inScheme', '{_B}vocabulary', 'iri' FROM t UNION SELECT p, '{rdf.SKOS}prefLabel', CASE predicate WHEN 'located_in' THEN 'Located in' WHEN 'based_in' THEN 'Based in' WHEN 'placed_by' THEN 'Placed by' WHEN 'contains' THEN 'Contains' ELSE 'Supplied by' END, 'literal' FROM t
    UNION SELECT st, '{rdf.RDFS}comment', annotation, 'literal' FROM t WHERE annotation IS NOT NULL""")
def rdf_triples(s, d):
    return rdf.triples(model.edges(s, d), model.pages(s, d), _B, VOCABULARY)


@query("rdf_ntriples", f"""SELECT '<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM ({ORACLES["rdf_triples"]})""")
def rdf_ntriples(s, d):
    return rdf.written(model.edges(s, d), model.pages(s, d), _B, VOCABULARY, "ntriples")


@query("rdf_turtle")
def rdf_turtle(s, d):
    return rdf.written(model.edges(s, d), model.pages(s, d), _B, VOCABULARY, "turtle")


@query("rdf_jsonld")
def rdf_jsonld(s, d):
    return rdf.written(model.edges(s, d), model.pages(s, d), _B, VOCABULARY, "jsonld")


def _uses(s, d):
    """Predicates as people write them: types of parts as files, brands as predicates with slips."""
    p = model.read(s, d, "part")
    low = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_")
    return p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file"), F.col("p_size").cast("int").alias("line"), F.when(F.col("p_partkey") % 41 == 0, F.concat(low, F.lit("s"))).when(F.col("p_partkey") % 3 == 0, "relates_to").when(F.col("p_partkey") % 29 == 0, "is_a").when(F.col("p_partkey") % 31 == 0, F.concat(F.lit("ex:"), low)).otherwise(low).alias("predicate"))


USES = """uses AS (SELECT 'f' || (p_partkey % 50) AS file, CAST(p_size AS INTEGER) AS line, CASE WHEN p_partkey % 41 = 0 THEN b || 's' WHEN p_partkey % 3 = 0 THEN 'relates_to' WHEN p_partkey % 29 = 0 THEN 'is_a' WHEN p_partkey % 31 = 0 THEN 'ex:' || b ELSE b END AS predicate
    FROM (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS b FROM part))"""
FREQ = f"{USES}, freq AS (SELECT predicate, count(*) AS n, min({{'file': file, 'line': line}}) AS f FROM uses GROUP BY 1)"


@query("predicate_frequencies", f"WITH {FREQ} SELECT predicate, n, f.file AS file, f.line AS line FROM freq")
def predicate_frequencies(s, d):
    return lint.frequencies(_uses(s, d))


@query("predicate_drift", f"WITH {FREQ} SELECT p.predicate, p.n, min(q.predicate) AS other, arg_min(q.n, q.predicate) AS other_n, p.f.file AS file, p.f.line AS line FROM freq p JOIN freq q ON p.predicate <> q.predicate AND q.n >= 5 * p.n AND levenshtein(p.predicate, q.predicate) <= 2 GROUP BY 1, 2, 5, 6")
def predicate_drift(s, d):
    return lint.spelling_drift(_uses(s, d))


@query("relates_to_overuse", """WITH u AS (SELECT 'f' || (p_partkey % 50) AS file, CAST(p_size AS INTEGER) AS line, CASE WHEN p_partkey % 50 < 20 AND p_partkey % 7 <> 0 THEN 'relates_to' ELSE 'other' END AS predicate FROM part)
    SELECT file, count(*) FILTER (WHERE predicate = 'relates_to') AS used, count(*) AS typed, min(line) FILTER (WHERE predicate = 'relates_to') AS line FROM u GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (WHERE predicate = 'relates_to') > 0.5 * count(*)""")
def relates_to_overuse(s, d):
    kind = F.when((F.col("p_partkey") % 50 < 20) & (F.col("p_partkey") % 7 != 0), "relates_to").otherwise("other")
    return lint.overuse(model.read(s, d, "part").select(F.concat(F.lit("f"), F.expr("cast(p_partkey % 50 as string)")).alias("file"), F.col("p_size").cast("int").alias("line"), kind.alias("predicate")))


@query("predicate_lints", f"""WITH {FREQ} SELECT kind, level, count(*) AS n FROM (SELECT 'predicate-prefer-conforms-to' AS kind, 'warning' AS level FROM uses WHERE predicate = 'is_a'
    UNION ALL SELECT 'predicate-undeclared', 'error' FROM uses WHERE predicate NOT IN ('relates_to', 'is_a') UNION ALL SELECT 'predicate-undeclared-prefix', 'info' FROM uses WHERE predicate LIKE 'ex:%'
    UNION ALL SELECT 'predicate-drift', 'warning' FROM freq p WHERE EXISTS (SELECT 1 FROM freq q WHERE p.predicate <> q.predicate AND q.n >= 5 * p.n AND levenshtein(p.predicate, q.predicate) <= 2)
    UNION ALL SELECT 'predicate-relates-to-overuse', 'info' FROM (SELECT file FROM uses GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (WHERE predicate = 'relates_to') > 0.5 * count(*))) GROUP BY 1, 2""")
def predicate_lints(s, d):
    found = lint.lints(_uses(s, d), lint.Vocabulary(labels={"relates_to": None, "is_a": None}, enforce=True))
    return found.groupBy("kind", "level").agg(F.count("*").alias("n"))


@query("tags_to_predicates", "SELECT DISTINCT 'c' || c_custkey AS source, 'in_domain' AS predicate, n_name AS target FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tags_to_predicates(s, d):
    c, n = model.read(s, d, "customer"), model.read(s, d, "nation")
    tags = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("page"), F.replace(F.upper("n_name"), F.lit("_"), F.lit("-")).alias("tag"))
    return lint.tags_to_predicates(tags, n.select(F.col("n_name").alias("page"), names.page_slug(F.concat(F.lit("geo/"), "n_name", F.lit(".md"))).alias("slug")))
