"""Queries of what is written, stored, explained and checked, over the driver's tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..logic import reason
from ..logic.rules import load_theory, save_theory
from ..operators import access, export, feed, find, graph, history, hooks, lint, merkle, search, segments
from ..scratch import scratch_root
from ..sources import epochs, vault
from ..streaming import seen, watch
from . import model
from .graphs import _markdown
from .registry import ORACLES, query
from .tables import _GROUND, _LEAVES, _TH, D, S, _leaves, _theory, read


def _place(s, name: str) -> str:
    """A folder of one run for what a query writes and reads back."""
    return f"{scratch_root(s)}/{name}-{uuid.uuid4().hex[:12]}"


# places in texts


@query("text_places", r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) // 2 AS o FROM documents)
    SELECT doc_id, length(left(text, o)) - length(replace(left(text, o), chr(10), '')) + 1 AS line, length(list_last(string_split(left(text, o), chr(10)))) + 1 AS "column", o AS back FROM t""")
def text_places(s, d):
    text = F.coalesce("text", F.lit(""))
    o = F.floor(F.char_length(text) / 2).cast("int")
    line, column = names.line_and_column(text, o)
    return read(s, d, "documents").select("doc_id", line.alias("line"), column.alias("column"), names.offset_of(text, line, column).alias("back"))


@query("line_kinds", """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'blank' WHEN 1 THEN 'heading' WHEN 2 THEN 'fence' WHEN 3 THEN 'rule' WHEN 4 THEN 'quote' WHEN 5 THEN 'task' WHEN 6 THEN 'bullet' WHEN 7 THEN 'ordered' ELSE 'paragraph' END AS kind FROM part""")
def line_kinds(s, d):
    lead = F.expr("element_at(array('  ', '## ', '```', '---', '> ', '- [x] ', '* ', '12. ', '#', ''), cast(p_partkey % 10 as int) + 1)")
    bare = F.expr("p_partkey % 10 in (0, 3)")
    return read(s, d, "part").select("p_partkey", names.line_kind(F.when(bare, lead).otherwise(F.concat(lead, "p_name"))).alias("kind"))


@query("blocks_of_type", f"WITH {_LEAVES} SELECT path, CAST(pos AS INTEGER) AS pos, hash FROM leaves WHERE type = 'heading'")
def blocks_of_type(s, d):
    return merkle.blocks_of(_leaves(s, d), "heading").select("path", F.col("pos").cast("int"), "hash")


@query("searched_below", "SELECT CAST(page_id AS VARCHAR) AS page, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*?(example[.][a-z]+/.*)$', 1) AS path FROM pages) WHERE starts_with(path, 'example.net/en/')")
def searched_below(s, d):
    p = read(s, d, "pages").select(S("page_id").alias("page"), F.regexp_extract("url", "^[a-z]+://[^/]*?(example[.][a-z]+/.*)$", 1).alias("path"))
    return p.filter(names.path_glob(F.col("path"), "example.net/en/"))


# Markdown


def _rules(s, d):
    """A page for each nation: a rule block, an open link and, for every other one, an empty link and a section."""
    n = read(s, d, "nation")
    text = F.concat(F.lit("# "), "n_name", F.lit("\n\n```spl\n(given big-"), S("n_nationkey"), F.lit(")\n```\n\nAn [[open link\n"), F.when(F.col("n_nationkey") % 2 == 0, "[[]]\n\n## More\n\n").otherwise(""), F.repeat(F.lit("word "), F.when(F.col("n_nationkey") % 5 == 0, 2000).otherwise(3).cast("int")), F.lit("\n"))
    return n.select(F.concat(F.lit("n/"), "n_name", F.lit(".md")).alias("path"), text.alias("content"))


@query("rule_blocks", "SELECT 'n/' || n_name || '.md' AS path, 3 AS start_line, 5 AS end_line, '(given big-' || n_nationkey || ')' AS content FROM nation")
def rule_blocks(s, d):
    return vault.Vault(_rules(s, d)).spl_blocks.select("path", "start_line", "end_line", "content")


@query("syntax_diagnostics", """SELECT 'n/' || n_name || '.md' AS path, 7 AS line, 4 AS "column", 'error' AS level, 'Unclosed wikilink: ''[[open link''' AS message FROM nation
    UNION ALL SELECT 'n/' || n_name || '.md', 8, 1, 'error', 'Empty wikilink: ''[[]]''' FROM nation WHERE n_nationkey % 2 = 0""")
def syntax_diagnostics(s, d):
    return vault.Vault(_rules(s, d)).diagnostics.select("path", "line", "column", "level", "message")


@query("page_chunks", """WITH t AS (SELECT 'n/' || n_name || '.md' AS path, '# ' || n_name || chr(10) || chr(10) || '```spl' || chr(10) || '(given big-' || n_nationkey || ')' || chr(10) || '```' || chr(10) || chr(10) || 'An [[open link' || chr(10) AS head,
        CASE WHEN n_nationkey % 2 = 0 THEN '[[]]' || chr(10) || chr(10) ELSE '' END AS empty, n_nationkey % 10 = 0 AS cut, n_nationkey % 2 = 0 AS two, repeat('word ', CASE WHEN n_nationkey % 5 = 0 THEN 2000 ELSE 3 END) || chr(10) AS tail FROM nation),
    p AS (SELECT path, 0 AS idx, CAST(NULL AS VARCHAR) AS heading, CASE WHEN cut THEN head || empty ELSE head || empty || CASE WHEN two THEN '## More' || chr(10) || chr(10) ELSE '' END || tail END AS text FROM t UNION ALL SELECT path, 1, 'More', '## More' || chr(10) || chr(10) || tail FROM t WHERE cut)
    SELECT path, idx, heading, sha256(text) AS content_hash FROM p""")
def page_chunks(s, d):
    return vault.Vault(_rules(s, d)).chunks.select("path", "idx", "heading", "content_hash")


@query("cached_pages", "SELECT 'geo/' || n_name || '.md' AS path, n_name AS page, '- locatedin::' || r_name || ' - as of 2024' AS description FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'region/' || r_name || '.md', r_name, 'Text ^note' FROM region")
def cached_pages(s, d):
    at = _place(s, "cache")
    vault.save_cache(vault.parse(_markdown(s, d)), at)
    return vault.load_cache(s, at).select("path", "page", "description")


@query("scanned_folder", "SELECT r_name AS page, 'in/' || r_name || '.md' AS path, '# ' || r_name AS content FROM region")
def scanned_folder(s, d):
    root = _place(s, "folder")
    hadoop = s._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for r in read(s, d, "region").select("r_name").collect():  # five rows
        for folder in ("in", ".hidden", "drafts"):
            out = fs.create(hadoop.Path(f"{root}/{folder}/{r[0]}.md"), True)
            out.write(bytearray(f"# {r[0]}".encode()))
            out.close()
    return vault.Vault.folder(s, root, exclude=("drafts/",)).pages.select("page", "path", "content")


@query("generated_vault", "SELECT count(*) AS pages, 12 * count(*) AS links, true AS some_ghosts, true AS some_links FROM customer")
def generated_vault(s, d):
    n = read(s, d, "customer").count()
    v = vault.Vault(vault.generate(s, n))
    told = graph.stats(v.edges, v.pages, with_components=False)
    return told.select(F.col("total_pages").alias("pages"), F.col("total_links").alias("links"), (F.col("dead_links") > 0).alias("some_ghosts"), (F.col("dead_links") < F.col("total_links")).alias("some_links"))


@query("page_predicates", f"""WITH {model.GRAPH}, p AS (SELECT source, predicate, min(line) AS line FROM edges_ WHERE predicate IS NOT NULL GROUP BY 1, 2) SELECT source, string_agg(predicate, ',' ORDER BY line) AS predicates FROM p GROUP BY 1""")
def page_predicates(s, d):
    links = model.edges(s, d).filter("predicate is not null").select("source", "line", F.array("predicate").alias("predicates"))
    return export.page_predicates(links).select("source", F.array_join("predicates", ",").alias("predicates"))


# vocabulary

_TOML = """
enforce = true
[predicates]
relates_to = {label = "Relates to"}
is_a = {state = "deprecated"}
[predicates.conforms_to]
state = "stable"
maps_to = "ex:conforms"
[prefixes]
ex = "http://example.org/"
"""


@query("configured_vocabulary", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'stable' ELSE 'emergent' END AS state FROM part")
def configured_vocabulary(s, d):
    v = lint.Vocabulary.from_toml(_TOML)
    p = F.expr("element_at(array('is_a', 'conforms_to', 'relates_to', 'other'), cast(p_partkey % 4 as int) + 1)")
    return read(s, d, "part").select("p_partkey", names.vocabulary_state(p, v.states).alias("state"))


@query("undeclared_predicates", """SELECT 'f' || p_partkey AS file, CAST(p_size AS INTEGER) AS line, CASE WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'info' END AS level,
    CASE WHEN p_partkey % 3 = 0 THEN '`relate_to::` is not declared (did you mean `relates_to`?)' ELSE 'prefix `geo:` is not declared' END AS message FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT 'f' || p_partkey, CAST(p_size AS INTEGER), 'error', '`geo:x::` is not declared' FROM part WHERE p_partkey % 3 = 1""")
def undeclared_predicates(s, d):
    v = lint.Vocabulary.from_toml(_TOML)
    uses = read(s, d, "part").select(F.concat(F.lit("f"), S("p_partkey")).alias("file"), F.col("p_size").cast("int").alias("line"), F.expr("element_at(array('relate_to', 'geo:x', 'conforms_to'), cast(p_partkey % 3 as int) + 1)").alias("predicate"))
    found = lint.lints(uses, v).filter("kind in ('predicate-undeclared', 'predicate-undeclared-prefix')")
    return found.select("file", "line", "level", "message")


# written forms


def _newest(s, d):
    o = read(s, d, "orders")
    items = o.select(F.concat(F.lit("o"), S("o_orderkey")).alias("id"), S("o_custkey").alias("title"), F.concat(F.lit("http://x.org/"), S("o_orderkey")).alias("url"), F.col("o_orderstatus").alias("summary"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"), F.array("o_orderpriority").alias("tags"))
    return feed.select_items(items, F.lit(True))


_TOP = "top AS (SELECT 'o' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS title, 'http://x.org/' || o_orderkey AS url, o_orderstatus AS summary, o_orderdate AS t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_published, o_orderpriority AS tag FROM orders ORDER BY date_published DESC, id LIMIT 50)"


@query("feed_documents", f"""WITH {_TOP} SELECT 'rss' AS kind, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>T</title><link>http://x.org</link>' || string_agg('<item><title>' || title || '</title><link>' || url || '</link><guid isPermaLink="false">' || id || '</guid><pubDate>' || strftime(t, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate><description>' || summary || '</description></item>', '' ORDER BY date_published DESC, id) || '</channel></rss>' AS document FROM top
    UNION ALL SELECT 'atom', '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><id>http://x.org</id>' || string_agg('<entry><id>' || id || '</id><title>' || title || '</title><link href="' || url || '"/><updated>' || date_published || '</updated><summary>' || summary || '</summary></entry>', '' ORDER BY date_published DESC, id) || '</feed>' FROM top
    UNION ALL SELECT 'json', '{{"version": "https://jsonfeed.org/version/1.1", "title": "T", "home_page_url": "http://x.org", "items": [' || string_agg('{{"id": "' || id || '", "url": "' || url || '", "title": "' || title || '", "summary": "' || summary || '", "date_published": "' || date_published || '", "tags": ["' || tag || '"]}}', ', ' ORDER BY date_published DESC, id) || ']}}' FROM top""")
def feed_documents(s, d):
    items, head = _newest(s, d), ("T", "http://x.org")
    return s.createDataFrame([("rss", feed.rss(items, *head)), ("atom", feed.atom(items, *head)), ("json", feed.json_feed(items, *head))], "kind string, document string")


@query("event_lines", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def event_lines(s, d):
    return export.json_lines(read(s, d, "events").select("event_id", "event_type"))


@query("event_log", """SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def event_log(s, d):
    at, e = _place(s, "log"), read(s, d, "events").select("event_id", "event_type")
    export.write_json_lines(e.filter("event_id % 2 = 0"), at)
    export.write_json_lines(e.filter("event_id % 2 = 1"), at)
    return s.read.schema("event_id long, event_type string").json(at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("event_epochs", "SELECT event_id, event_type FROM events")
def event_epochs(s, d):
    """The events as a stream, whose epoch is done twice, as by a driver that died before it was noted."""
    at, e = _place(s, "epochs"), read(s, d, "events").select("event_id", "event_type")
    for _ in range(2):
        stream = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
        epochs.start(stream, at, _place(s, "epochs-checkpoint")).awaitTermination()
    return epochs.read(s, at, "event_id long, event_type string")


@query("searched_index", r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents), sizes AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
    tf AS (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM t) WHERE term IN ('nicht', 'con') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN df USING (term), sizes GROUP BY 1""")
def searched_index(s, d):
    at = _place(s, "index")
    export.build_index(read(s, d, "documents"), at, "doc_id")
    return export.query_index(s, at, "nicht con").select("id", F.round("score", 6).alias("score"))


@query("edited_index", ORACLES["searched_index"] + " ORDER BY 2 DESC, 1 LIMIT 50")
def edited_index(s, d):
    """The best fifty after edits: first every text stands backwards beside a copy, then copies go and texts are put right."""
    index, docs = segments.SegmentIndex(s, _place(s, "segments"), "long"), read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    wrong = docs.select("id", F.reverse("text").alias("text"))
    copies = docs.select((-F.col("id") - 1).alias("id"), "text")
    index.edit(0, wrong.unionByName(copies))
    index.edit(1, docs, removed=copies.select("id"))
    return index.top("nicht con", 50).select("id", F.round("score", 6).alias("score"))


@query("first_seen_items")
def first_seen_items(s, d):
    """The events as feed items in three batches: those of which neither user and kind, nor minute and kind, nor value was new before."""
    e = read(s, d, "events")
    items = e.select(F.col("event_id").alias("seq"), F.concat_ws("/", "user_id", "event_type").alias("guid"), F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH:mm"), "event_type").alias("link"), F.coalesce(S("value"), F.lit("")).alias("hash"))
    cuts = e.agg(F.percentile_approx("event_id", [0.4, 0.7])).first()[0] or [0, 0]
    at = _place(s, "first-seen")
    step = seen.FirstSeen(s, f"{at}/state", lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"))
    for k, part in enumerate((items.filter(F.col("seq") <= cuts[0]), items.filter((F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1])), items.filter(F.col("seq") > cuts[1]))):
        step(part, k)
    return s.read.schema("seq long, guid string, link string, hash string, epoch long").parquet(f"{at}/out").select("seq", "guid", "link", "hash")


# stored states


@query("vector_index", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 2 = 0 THEN round(CAST(e.embedding[1] AS DOUBLE), 5) ELSE CAST(length(CAST(c_custkey AS VARCHAR)) AS DOUBLE) END AS first FROM customer LEFT JOIN embeddings e ON vec_id = c_custkey WHERE c_custkey % 2 = 1 OR vec_id IS NOT NULL UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(length(CAST(c_custkey AS VARCHAR)) AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT vec_id FROM embeddings)")
def vector_index(s, d):
    at = _place(s, "vectors")
    chunks = read(s, d, "customer").select(S("c_custkey").alias("path"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("heading"), S("c_custkey").alias("text"), F.md5(S("c_custkey")).alias("content_hash"))
    known = read(s, d, "embeddings").filter("vec_id % 2 = 0").select(F.md5(S("vec_id")).alias("content_hash"), "embedding")
    export.build_vectors(chunks, known, lambda texts: [[float(len(t))] for t in texts], at)
    return s.read.parquet(at).select("path", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("kept_states", "SELECT 'c' || r_regionkey AS state, r_regionkey >= 2 AS kept, CASE WHEN r_regionkey >= 2 THEN 1 ELSE 0 END AS pages FROM region")
def kept_states(s, d):
    root, regions = _place(s, "states"), read(s, d, "region")
    keys = sorted(r[0] for r in regions.select("r_regionkey").collect())  # five rows
    for k in keys:
        export.store_snapshot(regions.filter(F.col("r_regionkey") == k), root, f"c{k}")
    gone = export.evict_snapshots(s, root, 3)
    found = {k: export.load_snapshot(s, root, f"c{k}") for k in keys}
    return s.createDataFrame([(f"c{k}", f"c{k}" not in gone, 0 if f is None else f.count()) for k, f in found.items()], "state string, kept boolean, pages int")


_VERSIONS = f"{D}, versions AS (SELECT seq, 'd' || seq AS change_id, page AS path, CASE WHEN bool_or(target = 'error') THEN NULL ELSE string_agg(target, ',' ORDER BY target) END AS content FROM days_ GROUP BY 1, 2, 3)"


def _versions(s, d):
    """What each day wrote: a user's kinds of events, or nothing if there was an error, which removes the file."""
    v = model.days(s, d).groupBy("seq", F.col("page").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("t"))
    return v.select("seq", F.concat(F.lit("d"), S("seq")).alias("change_id"), "path", F.when(~F.array_contains("t", "error"), F.array_join("t", ",")).alias("content"))


_AT = "SELECT path, arg_max({{'c': content}}, seq).c AS content FROM versions WHERE seq <= {0} GROUP BY 1"


@query("tree_at_change", f"WITH {_VERSIONS} SELECT * FROM ({_AT.format(12)}) WHERE content IS NOT NULL")
def tree_at_change(s, d):
    return history.tree_at(_versions(s, d), "d12")


@query("file_at_change", f"WITH {_VERSIONS} SELECT * FROM ({_AT.format(12)}) WHERE content IS NOT NULL AND path = (SELECT min(path) FROM versions)")
def file_at_change(s, d):
    v = _versions(s, d)
    first = v.agg(F.min("path")).first()[0]
    return history.file_at(v, "d12", first or "")


@query("changed_files", f"""WITH {_VERSIONS}, o AS (SELECT * FROM ({_AT.format(9)}) WHERE content IS NOT NULL), n AS (SELECT * FROM ({_AT.format(12)}) WHERE content IS NOT NULL)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.content IS DISTINCT FROM n.content""")
def changed_files(s, d):
    return history.changed_names(_versions(s, d), "d9", "d12")


@query("stored_theory", f"WITH {_TH} SELECT 'same' AS asked, CAST(count(*) FILTER (WHERE has) + count(*) FILTER (WHERE small) AS BIGINT) AS facts, 3 * count(*) AS rules FROM th UNION ALL VALUES ('changed', NULL, NULL), ('typed links', NULL, NULL)")
def stored_theory(s, d):
    at, t = _place(s, "theory"), _theory(s, d)
    blocks = read(s, d, "nation").select(S("n_nationkey").alias("key"), F.md5("n_name").alias("ast_hash"))
    save_theory(t, blocks, at)
    plain = model.edges(s, d).filter("predicate is null")
    asked = {"same": (blocks, plain), "changed": (blocks.withColumn("ast_hash", F.lit("x")), plain), "typed links": (blocks, model.edges(s, d))}
    got = {k: load_theory(s, at, *v) for k, v in asked.items()}
    return s.createDataFrame([(k, g and g.facts.count(), g and g.rules.count()) for k, g in got.items()], "asked string, facts long, rules long")


# checks


_REFS = "refs AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 2 = 0 AS live, CAST(o_orderkey AS VARCHAR) AS target_path, CASE WHEN o_orderkey % 3 = 0 THEN 'gone' ELSE coalesce((SELECT min(hash) FROM leaves l WHERE l.path = CAST(o_orderkey AS VARCHAR)), 'none') END AS hash FROM orders)"


def _refs(s, d, leaves):
    least = leaves.groupBy("path").agg(F.min("hash").alias("least"))
    o = read(s, d, "orders").select(S("o_orderkey").alias("path"), "o_orderkey").join(least, "path", "left")
    return o.select("path", F.lit(3).alias("start_line"), F.col("path").alias("target_path"), F.when(F.col("o_orderkey") % 3 == 0, "gone").otherwise(F.coalesce("least", F.lit("none"))).alias("hash"), "o_orderkey")


@query("grounded_counts", f"""WITH {_GROUND}, {_REFS}, alive AS (SELECT path, pos + 1 AS start_line FROM g WHERE CAST(path AS BIGINT) % 2 = 0)
    SELECT (SELECT count(*) FROM alive) AS rule_blocks, (SELECT count(*) FROM g WHERE CAST(path AS BIGINT) % 2 = 0 AND grounding IS NOT NULL) AS grounded_blocks,
    (SELECT count(*) FROM refs r WHERE EXISTS (SELECT 1 FROM alive a WHERE a.path = r.path AND a.start_line = 3)) AS grounded_facts,
    (SELECT count(*) FROM refs r WHERE NOT EXISTS (SELECT 1 FROM leaves l WHERE l.path = r.target_path AND l.hash = r.hash)) AS broken_groundings""")
def grounded_counts(s, d):
    leaves = _leaves(s, d)
    g = merkle.groundings(leaves)
    live = g.filter(F.col("path").cast("long") % 2 == 0).select("path", "start_line")
    return merkle.grounded_counts(g, live, _refs(s, d, leaves), leaves)


@query("check_counters", f"""WITH {model.GRAPH}, {_LEAVES}, {_REFS}, dead AS (SELECT count(*) AS n FROM edges_ WHERE target NOT IN (SELECT page FROM pages_)), alone AS (SELECT count(DISTINCT page) AS n FROM pages_ WHERE page NOT IN (SELECT target FROM edges_))
    SELECT (SELECT n FROM dead) AS dead_links, (SELECT n FROM alone) AS orphans, count(*) FILTER (WHERE p_partkey % 4 = 0) AS syntax_errors, count(*) FILTER (WHERE p_partkey % 4 = 1 AND p_size % 3 = 0) AS spl_errors,
    count(*) FILTER (WHERE p_partkey % 4 = 2 AND p_size % 3 = 1) AS drift_warnings, count(*) FILTER (WHERE p_partkey % 4 = 2 AND p_size % 3 = 2) AS drift_info, (SELECT count(*) FROM leaves WHERE type = 'rules') AS total_spl_blocks,
    count(*) FILTER (WHERE p_partkey % 4 = 2 AND p_size % 3 = 1) AS drifted_blocks_warning, count(*) FILTER (WHERE p_partkey % 4 = 2 AND p_size % 3 = 2) AS drifted_blocks_info, (SELECT count(*) FROM refs) AS explicitly_grounded_facts,
    (SELECT count(*) FROM refs r WHERE NOT EXISTS (SELECT 1 FROM leaves l WHERE l.path = r.target_path AND l.hash = r.hash)) AS broken_groundings, count(*) FILTER (WHERE p_partkey % 4 = 3 AND p_size % 3 = 0) AS predicate_errors, count(*) FILTER (WHERE p_partkey % 4 = 3 AND p_size % 3 = 1) AS predicate_warnings,
    true AS fails_on_errors, true AS fails_on_warnings FROM part""")
def check_counters(s, d):
    told = read(s, d, "part").select(F.expr("element_at(array('syntax', 'rules', 'drift', 'predicate'), cast(p_partkey % 4 as int) + 1)").alias("kind"), F.expr("element_at(array('error', 'warning', 'info'), cast(p_size % 3 as int) + 1)").alias("level"))
    leaves = _leaves(s, d)
    return graph.check(model.edges(s, d), model.pages(s, d), told, merkle.blocks_of(leaves, "rules"), _refs(s, d, leaves), leaves)


@query("checked_references", f"""WITH {_LEAVES} SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'unknown' WHEN 2 THEN 'local' ELSE 'cross_file' END AS class,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 8 = 0 WHEN 1 THEN false ELSE EXISTS (SELECT 1 FROM leaves l WHERE l.path = CAST(o_orderkey AS VARCHAR) AND l.block_id = 'b' || (o_custkey % 20 * 5)) END AS ok FROM orders""")
def checked_references(s, d):
    o = read(s, d, "orders").withColumn("b", F.concat(F.lit("^b"), F.expr("cast(o_custkey % 20 * 5 as string)")))
    ref = F.expr("case o_orderkey % 4 when 0 then concat('[[', if(o_orderkey % 8 = 0, '', 'no '), o_orderkey, ']]') when 1 then 'what?' when 2 then b else concat('[[', o_orderkey, '#', b, ']]') end")
    refs = o.select(S("o_orderkey").alias("path"), ref.alias("ref"))
    pages = o.select(S("o_orderkey").alias("page"), S("o_orderkey").alias("path"))
    return merkle.check_references(refs, _leaves(s, d), pages).select("path", "class", "ok")


@query("verified_comments", f"""WITH c AS (SELECT c_custkey, c_name AS body, sha256(unhex('{bytes(x ^ 0x5C for x in b"key".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in b"key".ljust(64, bytes(1))).hex()}') || encode(c_name)))) AS mac FROM customer) SELECT c_custkey, c_custkey % 3 <> 0 AS valid, mac FROM c""")
def verified_comments(s, d):
    import hmac

    sign = F.pandas_udf(lambda x: x.map(lambda t: hmac.new(b"key", t.encode(), hashlib.sha256).hexdigest()), "string")
    c = read(s, d, "customer").select("c_custkey", F.col("c_name").alias("body"), sign("c_name").alias("mac"))
    told = access.verify_comments(c.withColumn("hmac", F.when(F.col("c_custkey") % 3 == 0, F.reverse("mac")).otherwise(F.upper("mac"))), b"key")
    return told.select("c_custkey", "valid", "mac")


@query("pruned_comments", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01'")
def pruned_comments(s, d):
    return access.prune_comments(read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")), "1996-01-01").select("o_orderkey")


# feeds


_SUBS = "subs AS (SELECT 's' || n_nationkey AS subscription, CASE n_nationkey % 4 WHEN 0 THEN 'CC0-1.0' WHEN 1 THEN 'CC-BY-4.0' END AS license, n_nationkey % 5 <> 0 AS republish, CASE WHEN n_nationkey % 3 = 0 THEN 'full' ELSE 'excerpt' END AS mode, n_nationkey % 7 = 0 AS permitted FROM nation)"


def _inbound(s, d):
    items = read(s, d, "customer").select(F.col("c_name").alias("id"), F.concat(F.lit("s"), S("c_nationkey")).alias("subscription"), F.expr("if(c_custkey % 2 = 0, 'https://creativecommons.org/licenses/by-sa/4.0/', null)").alias("link"), F.array(F.lit("all rights")).alias("rights"), F.concat(F.lit("<p>Hello "), "c_name", F.lit(".</p> "), F.repeat(F.lit("more "), F.lit(200))).alias("content"))
    n = read(s, d, "nation")
    subs = n.select(F.concat(F.lit("s"), S("n_nationkey")).alias("subscription"), F.expr("case n_nationkey % 4 when 0 then 'CC0-1.0' when 1 then 'CC-BY-4.0' end").alias("license"), F.expr("n_nationkey % 5 <> 0").alias("republish"), F.expr("if(n_nationkey % 3 = 0, 'full', 'excerpt')").alias("mode"), F.expr("n_nationkey % 7 = 0").alias("permitted"))
    return items, subs


@query("inbound_items", f"""WITH {_SUBS}, i AS (SELECT c_name AS id, s.*, c_custkey % 2 = 0 AS linked FROM customer JOIN subs s ON s.subscription = 's' || c_nationkey),
    l AS (SELECT *, coalesce(license, CASE WHEN linked THEN 'CC-BY-SA-4.0' END, 'NOASSERTION') AS lic FROM i),
    m AS (SELECT *, CASE WHEN NOT republish THEN 'deny' WHEN lic = 'CC0-1.0' THEN 'full' WHEN lic = 'CC-BY-4.0' THEN mode WHEN lic = 'CC-BY-SA-4.0' THEN 'excerpt' WHEN permitted THEN mode ELSE 'deny' END AS shown FROM l)
    SELECT id, lic AS license, CASE lic WHEN 'CC0-1.0' THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 'CC-BY-4.0' THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 'CC-BY-SA-4.0' THEN 'https://creativecommons.org/licenses/by-sa/4.0/' END AS license_url,
    license IS NOT NULL AND linked AS drifted, shown AS mode, CASE WHEN shown = 'deny' OR lic = 'NOASSERTION' AND NOT permitted THEN 'unknown_default_deny' WHEN lic = 'CC0-1.0' THEN 'public_domain' WHEN lic = 'CC-BY-4.0' THEN 'cc_by_' || mode WHEN lic = 'CC-BY-SA-4.0' THEN 'cc_by_sa_incompatible' ELSE 'unknown_operator_permitted' END AS reason,
    CASE shown WHEN 'full' THEN '<p>Hello ' || id || '.</p> ' || repeat('more ', 200) WHEN 'excerpt' THEN 'Hello ' || id || '.' END AS body FROM m""")
def inbound_items(s, d):
    return feed.inbound(*_inbound(s, d), None, False)


@query("retracted_items", "SELECT c_name AS id, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 3 = 0 THEN '2024-01-01T00:00:00Z' END AS retracted_at FROM customer")
def retracted_items(s, d):
    c = read(s, d, "customer")
    kept = c.select(S("c_nationkey").alias("subscription"), F.col("c_name").alias("id"))
    # a feed that has no item left but one of its own still counts as fetched
    now = c.filter("c_nationkey % 2 = 0 and c_custkey % 3 <> 0").select(S("c_nationkey").alias("subscription"), F.col("c_name").alias("id"))
    fetched = read(s, d, "nation").filter("n_nationkey % 2 = 0").select(S("n_nationkey").alias("subscription"), F.lit("own").alias("id"))
    return feed.retracted(kept, now.unionByName(fetched), "2024-01-01T00:00:00Z").select("id", "retracted_at")


@query("cohort_feeds", """WITH p AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'x/caps/' ELSE 'landscaps/' END || o_orderkey AS slug, o_orderdate, o_orderstatus AS cohort FROM orders)
    SELECT cohort, rank, id FROM (SELECT cohort, id, CAST(row_number() OVER (PARTITION BY cohort ORDER BY o_orderdate DESC, id) AS INTEGER) AS rank FROM p WHERE cohort <> 'P' AND slug LIKE 'landscaps/%') WHERE rank <= 50""")
def cohort_feeds(s, d):
    slug = F.concat(F.expr("if(o_orderkey % 4 = 0, 'x/caps/', 'landscaps/')"), S("o_orderkey"))
    o = read(s, d, "orders").withColumn("slug", slug)
    pages = o.select("slug", F.concat(F.lit("o"), S("o_orderkey")).alias("id"), F.col("o_orderdate").alias("date_published"))
    cohorts = o.select(F.col("o_orderstatus").alias("cohort"), (F.col("o_orderstatus") != "P").alias("enabled")).distinct()
    return feed.cohort_feeds(pages, o.select(F.col("o_orderstatus").alias("cohort"), "slug"), cohorts)


# hooks


def _hooks():
    def tag(tree, page):
        if page.metadata["k"] == 1:
            raise ValueError("no")
        page.emit("seen", page.path)
        return {**tree, "title": tree["title"].upper()}

    return [hooks.Hook("low", "pre_parse", lambda t, page: t.lower()), hooks.Hook("up", "transform", tag, off_key="up"), hooks.Hook("wrap", "post_render", lambda t, page: f"<main>{t}</main>")]


def _hooked(s, d):
    meta = F.concat(F.lit('{"k": '), F.expr("cast(c_custkey % 4 as string)"), F.when(F.col("c_custkey") % 4 == 2, ', "up": false').otherwise(""), F.lit("}"))
    return read(s, d, "customer").select(F.col("c_name").alias("path"), F.col("c_name").alias("content"), meta.alias("frontmatter"))


@query("page_pipeline", "SELECT c_name AS path, '<main><h1>' || CASE WHEN c_custkey % 4 IN (1, 2) THEN lower(c_name) ELSE upper(c_name) END || '</h1></main>' AS html, CASE WHEN c_custkey % 4 IN (1, 2) THEN 0 ELSE 1 END AS emitted FROM customer")
def page_pipeline(s, d):
    done = hooks.run_pipeline(_hooked(s, d), _hooks(), lambda text: {"title": text}, lambda tree: f"<h1>{tree['title']}</h1>")
    return done.select("path", "html", F.size("emitted").alias("emitted"))


@query("hook_statistics", "SELECT 'pre_parse' AS stage, 'low' AS hook, count(*) AS ran, 0 AS failed FROM customer UNION ALL SELECT 'transform', 'up', count(*) FILTER (WHERE c_custkey % 4 IN (0, 3)), count(*) FILTER (WHERE c_custkey % 4 = 1) FROM customer UNION ALL SELECT 'post_render', 'wrap', count(*), 0 FROM customer")
def hook_statistics(s, d):
    return hooks.hook_statistics(hooks.run_pipeline(_hooked(s, d), _hooks(), lambda text: {"title": text}, lambda tree: f"<h1>{tree['title']}</h1>"))


@query("tree_hooks", """SELECT c_name AS path, CASE WHEN c_custkey % 4 IN (1, 2) THEN '{"title":"' || c_name ELSE '{"title": "' || upper(c_name) END || '"}' AS content, c_custkey % 4 = 1 AS failed FROM customer""")
def tree_hooks(s, d):
    trees = _hooked(s, d).withColumn("content", F.to_json(F.struct(F.col("content").alias("title"))))
    return hooks.run_stage(trees, _hooks(), "transform").select("path", "content", (F.size("failed") > 0).alias("failed"))


@query("html_hooks", "SELECT c_name AS path, '<main>' || c_name || '</main>' AS content FROM customer")
def html_hooks(s, d):
    return hooks.run_stage(_hooked(s, d), _hooks(), "post_render").select("path", "content")


# reasoning


@query("explained", f"WITH {_TH} SELECT 0 AS depth, 'known-' || k AS literal, '+D' AS tag, 't' || k AS rule, 'has-' || k AS body FROM th WHERE has AND k = 4 UNION ALL SELECT 1, 'has-' || k, '+D', NULL, NULL FROM th WHERE has AND k = 4")
def explained(s, d):
    t = _theory(s, d)
    return reason.explain(t, reason.conclusions(t), "known-4").select("depth", "literal", "tag", "rule", F.array_join("body", ",").alias("body"))


@query("explained_failure", f"""WITH {_TH}, t AS (SELECT '~exporter-' || k AS literal, CASE WHEN small AND NOT has THEN '+d' ELSE '-d' END AS tag FROM th UNION ALL SELECT 'small-' || k, CASE WHEN small THEN '+D' ELSE '-d' END FROM th)
    SELECT 0 AS depth, literal, tag, 's1' AS rule, 'for' AS role, 'small-1' AS body, 'small-1' AS lacking, 'n1.md' AS path FROM th JOIN t ON literal = '~exporter-1' WHERE k = 1
    UNION ALL SELECT 0, literal, tag, 'e1', 'against', 'has-1', CASE WHEN has THEN '' ELSE 'has-1' END, 'n1.md' FROM th JOIN t ON literal = '~exporter-1' WHERE k = 1
    UNION ALL SELECT 1, literal, tag, NULL, NULL, NULL, NULL, NULL FROM t WHERE literal = 'small-1'""")
def explained_failure(s, d):
    t = _theory(s, d)
    told = reason.explain_failure(t, reason.conclusions(t), "~exporter-1")
    return told.select("depth", "literal", "tag", "rule", "role", F.array_join("body", ",").alias("body"), F.array_join("lacking", ",").alias("lacking"), "path")


@query("conflict_suggestions", f"""WITH {_TH} SELECT 'exporter-' || k AS literal, 'e' || k AS rule, 'prefer' AS action, 's' || k AS other FROM th UNION ALL SELECT 'exporter-' || k, 's' || k, 'prefer', 'e' || k FROM th
    UNION ALL SELECT 'exporter-' || k, 'e' || k, 'weaken', NULL FROM th UNION ALL SELECT 'exporter-' || k, 's' || k, 'weaken', NULL FROM th""")
def conflict_suggestions(s, d):
    return reason.suggestions(_theory(s, d))


@query("blocked_rules", f"WITH {_TH} SELECT 's1' AS rule, 'failed_body' AS blocker, 'small-1' AS what FROM th WHERE k = 1 UNION ALL SELECT 's4', 'defeated', 'e4' FROM th WHERE k = 4 AND has UNION ALL SELECT 's4', 'failed_body', 'small-4' FROM th WHERE k = 4 AND NOT small")
def blocked_rules(s, d):
    t = _theory(s, d)
    found = reason.conclusions(t)
    return reason.why_not(t, found, "~exporter-1").unionByName(reason.why_not(t, found, "~exporter-4"))


@query("conclusion_status", f"WITH {_TH} SELECT 'known-' || k AS literal, '+D' AS tag FROM th WHERE has AND k >= 10 AND k < 20")
def conclusion_status(s, d):
    return reason.status(reason.conclusions(_theory(s, d)), positive=True, definite=True, pattern="known-1?")


@query("matching_conclusions", f"WITH {_TH} SELECT 'exporter-' || k AS literal, CASE WHEN has AND (NOT small OR pref) THEN '+d' ELSE '-d' END AS tag FROM th WHERE k % 10 = 3 UNION ALL SELECT '~exporter-' || k, CASE WHEN small AND NOT has THEN '+d' ELSE '-d' END FROM th WHERE k % 10 = 3")
def matching_conclusions(s, d):
    return reason.status(reason.conclusions(_theory(s, d)), definite=False, pattern="*exporter-*3")


@query("page_conclusions", f"""WITH {_TH}, c AS (SELECT k, 'has-' || k AS literal, '+D' AS tag FROM th WHERE has UNION ALL SELECT k, 'known-' || k, '+D' FROM th WHERE has UNION ALL SELECT k, 'small-' || k, '+D' FROM th WHERE small
        UNION ALL SELECT k, 'exporter-' || k, '+d' FROM th WHERE has AND (NOT small OR pref) UNION ALL SELECT k, '~exporter-' || k, '+d' FROM th WHERE small AND NOT has)
    SELECT CAST(k AS VARCHAR) AS page, string_agg(literal || ' ' || tag, ', ' ORDER BY literal) AS conclusions FROM c GROUP BY 1""")
def page_conclusions(s, d):
    t = _theory(s, d)
    found = reason.conclusions_by_page(t, reason.conclusions(t))
    return found.select("page", F.array_join(F.transform("conclusions", lambda x: F.concat_ws(" ", x["literal"], x["tag"])), ", ").alias("conclusions"))


@query("fresh_conclusions", f"WITH {_TH} SELECT 'small-' || k AS literal, 'n' || k || '.md' AS path, k % 3 = 0 AS fresh FROM th WHERE small")
def fresh_conclusions(s, d):
    t = _theory(s, d)
    spans = read(s, d, "nation").select(F.concat(F.lit("n"), S("n_nationkey"), F.lit(".md")).alias("path"), F.lit(1).alias("start_line"), F.lit(99).alias("end_line"), F.md5("n_name").alias("grounding"), "n_nationkey")
    old = spans.withColumn("grounding", F.when(F.col("n_nationkey") % 3 == 0, F.col("grounding")).otherwise("x"))
    return reason.provenance(t, reason.conclusions(t), spans, old).filter("literal like 'small-%'").select("literal", "path", "fresh")


@query("theory_statements", f"""WITH {_TH} SELECT '(given has-' || k || ')' AS value FROM th WHERE has UNION ALL SELECT '(given small-' || k || ')' FROM th WHERE small UNION ALL SELECT '(normally e' || k || ' has-' || k || ' exporter-' || k || ')' FROM th
    UNION ALL SELECT '(normally s' || k || ' small-' || k || ' (not exporter-' || k || '))' FROM th UNION ALL SELECT '(always t' || k || ' has-' || k || ' known-' || k || ')' FROM th UNION ALL SELECT '(prefer e' || k || ' s' || k || ')' FROM th WHERE pref""")
def theory_statements(s, d):
    return reason.export(_theory(s, d))


# facades


@query("page_card", f"""WITH {model.GRAPH} SELECT page, path, '' AS description, (SELECT count(*) FROM edges_ WHERE source = 'order:7') AS out_links, (SELECT count(*) FROM edges_ WHERE target = 'order:7') AS backlinks,
    (SELECT count(*) FROM edges_ WHERE source = 'order:7' AND target NOT IN (SELECT page FROM pages_)) AS dead_links FROM pages_ WHERE page = 'order:7'""")
def page_card(s, d):
    return find.page_card(model.edges(s, d), model.pages(s, d).withColumn("description", F.lit("")), "Order:7")


@query("vault_status", f"""WITH {model.GRAPH}, {_TH} SELECT (SELECT count(DISTINCT page) FROM pages_) AS total_pages, (SELECT count(*) FROM edges_) AS total_links, (SELECT count(*) FROM edges_ WHERE target NOT IN (SELECT page FROM pages_)) AS dead_links, (SELECT count(DISTINCT page) FROM pages_ WHERE page NOT IN (SELECT target FROM edges_)) AS orphan_count,
    2 * count(*) FILTER (WHERE has) + count(*) FILTER (WHERE small) AS definite, 2 * count(*) FILTER (WHERE has) + count(*) FILTER (WHERE small) + count(*) FILTER (WHERE has AND (NOT small OR pref)) + count(*) FILTER (WHERE small AND NOT has) AS provable FROM th""")
def vault_status(s, d):
    return find.status(model.edges(s, d), model.pages(s, d), reason.conclusions(_theory(s, d)))


@query("lint_messages", """SELECT 'f' || p_partkey AS file, CAST(p_size AS INTEGER) AS line, 'warning' AS level, '`is_a::` asserts identity; prefer `conforms_to::`' AS message FROM part WHERE p_partkey % 5 = 0""")
def lint_messages(s, d):
    uses = read(s, d, "part").select(F.concat(F.lit("f"), S("p_partkey")).alias("file"), F.col("p_size").cast("int").alias("line"), F.expr("if(p_partkey % 5 = 0, 'is_a', 'conforms_to')").alias("predicate"))
    return lint.lints(uses).filter("kind = 'predicate-prefer-conforms-to'").select("file", "line", "level", "message")


@query("line_contexts", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), h AS (SELECT *, strpos(lower(line), 'nicht') AS p FROM l WHERE strpos(lower(line), 'nicht') > 0)
    SELECT doc_id AS id, CAST(n AS INTEGER) AS line, substring(line, greatest(p - 40, 1), p - greatest(p - 40, 1) + 45) AS context FROM h""")
def line_contexts(s, d):
    return search.line_matches(read(s, d, "documents"), "nicht", "doc_id").select("id", "line", "context")


# a watched vault, run trigger by trigger


@query("watched_vault", """SELECT 0 AS epoch, 'page_added' AS event, n_name AS page, NULL AS target FROM nation UNION ALL SELECT 0, 'link_added', n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 0, 'orphan_gained', n_name, NULL FROM nation UNION ALL SELECT 0, 'dead_gained', n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 1, unnest(['page_removed', 'orphan_resolved']), n_name, NULL FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 1, unnest(['link_removed', 'dead_resolved']), n_name, 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT unnest([0, 1]), 'index_updated', NULL, NULL""")
def watched_vault(s, d):
    at = _place(s, "events")
    n = read(s, d, "nation").select(F.concat("n_name", F.lit(".md")).alias("path"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("See [[r"), S("n_regionkey"), F.lit("]].")).alias("content"))

    def parsed(pages):
        v = vault.Vault(pages)
        return v.edges.select("source", "target"), v.pages.select("page", "path")

    w = watch.Watch(s, parsed, lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/n={epoch}"), _place(s, "watch"))
    w.batch(n, 0)
    w.batch(n.withColumn("content", F.when(F.col("seq") % 5 != 0, F.col("content"))), 1)
    return s.read.parquet(at).select("epoch", "event", "page", "target")


@query("reconciled_edits", "SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'drop' ELSE 'reload' END AS action FROM customer WHERE c_custkey % 5 IN (0, 1, 2)")
def reconciled_edits(s, d):
    c = read(s, d, "customer").select(F.concat(F.lit("c"), S("c_custkey")).alias("path"), F.col("c_name").alias("content"), "c_custkey")
    files = c.filter("c_custkey % 5 <> 0").withColumn("content", F.when(F.col("c_custkey") % 5 == 1, F.lower("content")).otherwise(F.col("content")))
    return watch.reconcile(c.filter("c_custkey % 5 <> 2"), files)
