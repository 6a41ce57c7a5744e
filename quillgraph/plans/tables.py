"""Queries of the other operators over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import dates, hashes, names
from ..logic import reason
from ..logic.rules import Theory, edge_facts
from ..operators import access, export, feed, find, graph, history, hooks, html, merge, merkle, predicate, search
from ..sources import markdown, vault
from ..streaming import watch
from . import model
from .registry import query

read = model.read
NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
S = lambda c: F.col(c).cast("string")


# names and other functions


@query("name_functions", """SELECT p_partkey, translate(lower(p_name), '-_', '  ') AS normal, p_name AS page, lower('Parts/' || replace(p_name, ' ', '-')) AS slug, replace(lower(p_name), ' ', '-') AS heading, '#' || replace(lower(p_name), ' ', '-') AS fragment FROM part""")
def name_functions(s, d):
    path = F.concat(F.lit("Parts/"), "p_name", F.lit(".md"))
    return read(s, d, "part").select("p_partkey", names.normalize_name(F.col("p_name")).alias("normal"), names.page_name(path).alias("page"), names.page_slug(path).alias("slug"), names.heading_slug(F.concat(F.lit("  "), F.upper("p_name"), F.lit("!"))).alias("heading"), names.link_fragment(F.concat(F.lit("x#"), "p_name")).alias("fragment"))


_P = "(CASE p_partkey % 5 WHEN 0 THEN lower(replace(p_name, ' ', '_')) WHEN 1 THEN 'ex:' || replace(p_name, ' ', '') WHEN 2 THEN p_brand WHEN 3 THEN 'a b' ELSE 'x9' END)"


@query("predicate_forms", f"""SELECT p_partkey, regexp_full_match(p, '[a-z][a-z0-9_]*') AS snake, regexp_full_match(p, '[a-z][a-z0-9]*:[A-Za-z][A-Za-z0-9_-]*') AS curie,
    CASE WHEN contains(p, ':') THEN replace(split_part(p, ':', 2), '_', ' ') ELSE upper(substr(replace(p, '_', ' '), 1, 1)) || substr(replace(p, '_', ' '), 2) END AS label, CASE p WHEN 'x9' THEN 'stable' ELSE 'emergent' END AS state FROM (SELECT p_partkey, {_P} AS p FROM part)""")
def predicate_forms(s, d):
    p = F.expr(_P)
    df = read(s, d, "part").select("p_partkey", p.alias("p"))
    return df.select("p_partkey", names.is_snake(F.col("p")).alias("snake"), names.is_curie(F.col("p")).alias("curie"), names.auto_label(F.col("p")).alias("label"), names.vocabulary_state(F.col("p"), {"x9": "stable"}).alias("state"))


@query("source_ref_classes", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cross_file' WHEN 1 THEN 'page' WHEN 2 THEN 'local' WHEN 3 THEN 'hash' ELSE 'unknown' END AS class FROM part""")
def source_ref_classes(s, d):
    ref = F.expr("case p_partkey % 5 when 0 then '[[' || p_name || '^b1]]' when 1 then '[[' || p_name || ']]' when 2 then '^b' || p_partkey when 3 then substr(md5(p_name), 1, 12) else p_name end")
    return read(s, d, "part").select("p_partkey", names.source_ref_class(ref).alias("class"))


@query("edit_distances", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS away FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_distances(s, d):
    n = read(s, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"{x}k"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").filter("ak < bk").select("a", "b", names.edit_distance(F.col("a"), F.col("b")).cast("long").alias("away"))


@query("literal_patterns", "SELECT p_partkey, contains(p_name, 'bolt') AS part_of, regexp_full_match(p_name, '.*b.lt') AS glob FROM part")
def literal_patterns(s, d):
    return read(s, d, "part").select("p_partkey", names.literal_matches(F.col("p_name"), "bolt").alias("part_of"), names.literal_matches(F.col("p_name"), "*b?lt").alias("glob"))


@query("ages_in_words", """SELECT o_orderkey, CASE WHEN n < 1 THEN 'today' WHEN n < 7 THEN n || 'd' WHEN n < 30 THEN (n // 7) || 'w' WHEN n < 365 THEN (n // 30) || 'mo' ELSE (n // 365) || 'y' END AS age FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS n FROM orders)""")
def ages_in_words(s, d):
    return read(s, d, "orders").select("o_orderkey", dates.humanise_days(F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))).alias("age"))


@query("temporal_relations", "SELECT event_id, CASE WHEN k < 20 THEN 'before' WHEN k = 20 THEN 'meets' WHEN k < 60 THEN 'within' WHEN k = 60 THEN 'finishes' ELSE 'after' END AS relation FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)")
def temporal_relations(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(s, d, "events").select("event_id", dates.temporal_relation(k, F.lit(20), F.lit(60)).alias("relation"))


_V = "CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR)"


@query("version_ranges", """SELECT p_partkey, a = 1 AND (b, c) >= (2, 1) AS caret, (a, b) = (1, 2) AND c >= 1 AS tilde, (a, b, c) >= (1, 0, 0) AND (a, b, c) < (2, 3, 0) AS span FROM (SELECT p_partkey, p_size % 4 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c FROM part)""")
def version_ranges(s, d):
    v = F.concat_ws(".", *((F.col(c) % n).cast("string") for c, n in (("p_size", 4), ("p_partkey", 7), ("p_partkey", 3))))
    return read(s, d, "part").select("p_partkey", names.version_satisfies(v, "^1.2.1").alias("caret"), names.version_satisfies(v, "~1.2.1").alias("tilde"), names.version_satisfies(v, ">=1.0.0, <2.3").alias("span"))


@query("archive_ranges", "SELECT event_id, (event_id // 250) * 250 AS first, (event_id // 250) * 250 + 250 AS stop FROM events")
def archive_ranges(s, d):
    a, b = dates.archive_range(F.col("event_id"), 250)
    return read(s, d, "events").select("event_id", a.alias("first"), b.alias("stop"))


@query("resolved_dates", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' END AS published,
    CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'created' WHEN 2 THEN 'date' WHEN 3 THEN 'published' END AS source, CASE o_orderkey % 5 WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 4 THEN 'missing' END AS error FROM orders""")
def resolved_dates(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    sources = [("published", F.when(k == 3, "1969-12-31").otherwise(" ")), ("date", F.when(k == 0, day).when(k == 2, F.concat(day, F.lit("T10:00:00")))), ("created", F.when(k == 1, F.concat(day, F.lit("T10:00:00Z"))))]
    at, source, error = dates.resolve_date(sources)
    return read(s, d, "orders").select("o_orderkey", at.alias("published"), source.alias("source"), error.alias("error"))


@query("item_ids", "SELECT c_custkey, 'tag:example.org,2024:notes/' || lower(c_name) AS id FROM customer")
def item_ids(s, d):
    return read(s, d, "customer").select("c_custkey", names.item_id(F.lower("c_name"), F.lit("example.org"), F.lit(2024), "notes").alias("id"))


@query("commit_trailers", "SELECT c_custkey, md5(c_name) || md5(c_name) AS vault_root_hash, c_name AS author, lower(c_mktsegment) || '@example.org' AS email FROM customer")
def commit_trailers(s, d):
    text = F.concat(F.lit("snapshot vault_root_hash="), F.md5("c_name"), F.md5("c_name"), F.lit("\n\nCo-authored-by: "), "c_name", F.lit(" <"), F.lower("c_mktsegment"), F.lit("@example.org>\n"))
    df = read(s, d, "customer").select("c_custkey", dates.vault_hash(text).alias("vault_root_hash"), F.explode(dates.co_authors(text)).alias("a"))
    return df.select("c_custkey", "vault_root_hash", F.col("a.name").alias("author"), F.col("a.email").alias("email"))


@query("block_ids", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END AS block_id FROM customer")
def block_ids(s, d):
    return read(s, d, "customer").select("c_custkey", names.block_id(F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" ^b"), S("c_custkey"))).otherwise(F.concat("c_name", F.lit("^x")))).alias("block_id"))


@query("hamming", "SELECT event_id, bit_count(xor(event_id, user_id * 7)) AS away FROM events")
def hamming(s, d):
    return read(s, d, "events").select("event_id", hashes.hamming(F.col("event_id"), F.col("user_id") * 7).cast("long").alias("away"))


@query("leaf_hashes", "SELECT doc_id, sha256('paragraph' || chr(0) || text) AS hash FROM documents")
def leaf_hashes(s, d):
    return read(s, d, "documents").select("doc_id", hashes.leaf_hash(F.lit("paragraph"), F.col("text")).alias("hash"))


@query("description_lengths")
def description_lengths(s, d):
    def run(batches):
        for b in batches:
            b["description"] = [markdown.description(t or "") for t in b.pop("text")]
            b["n"] = b["description"].str.len()
            yield b

    return read(s, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, description string, n int")


# search

_T = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query("bm25", f"""WITH d AS (SELECT doc_id, unnest({_T}) AS term, len({_T}) AS dl FROM documents), sizes AS (SELECT count(*) AS n, avg(len({_T})) AS mean FROM documents),
    tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM d WHERE term IN ('thing', 'nicht', 'con') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN df USING (term), sizes GROUP BY 1""")
def bm25(s, d):
    return search.search(read(s, d, "documents"), "Thing, nicht con", id_col="doc_id").select("id", F.round("score", 6).alias("score"))


@query("postings", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY 1")
def postings(s, d):
    return search.term_counts(read(s, d, "documents"), "doc_id")


@query("line_matches", """SELECT doc_id AS id, CAST(n AS INTEGER) AS line, CAST(strpos(lower(line), 'nicht') AS INTEGER) AS "column" FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE strpos(lower(line), 'nicht') > 0""")
def line_matches(s, d):
    return search.line_matches(read(s, d, "documents"), "nicht", "doc_id").select("id", "line", "column")


@query("headings_as_of", "SELECT CAST(e.user_id AS VARCHAR) AS path, e.event_id AS offset, p.event_type AS heading FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('signup', 'error')) p ON e.user_id = p.user_id AND e.event_id >= p.event_id")
def headings_as_of(s, d):
    e = read(s, d, "events").select(S("user_id").alias("path"), F.col("event_id").alias("offset"), "event_type")
    heads = e.filter("event_type in ('signup', 'error')").select("path", "offset", F.lit(1).alias("level"), F.col("event_type").alias("text"))
    return search.with_headings(e.select("path", "offset", F.lit(1).alias("hit")), heads).select("path", "offset", "heading")


@query("vector_top", "SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 5) AS score FROM embeddings ORDER BY list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) DESC, vec_id LIMIT 20")
def vector_top(s, d):
    v = read(s, d, "embeddings")
    asked = v.filter("vec_id = 7").first()
    return search.vector_top(v, asked["embedding"] if asked else [], 20).select("id", F.round("score", 5).alias("score"))


@query("rank_fusion", """WITH a AS (SELECT user_id, row_number() OVER (ORDER BY sum(value) DESC, user_id) AS r FROM events GROUP BY 1 QUALIFY r <= 50), b AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1 QUALIFY r <= 50)
    SELECT user_id AS page, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def rank_fusion(s, d):
    e = read(s, d, "events").groupBy(F.col("user_id").alias("page")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    a = search.ranked_pages(e.orderBy(F.desc("v"), "page").limit(50), [F.desc("v"), F.col("page")])
    b = search.ranked_pages(e.orderBy(F.desc("n"), "page").limit(50), [F.desc("n"), F.col("page")])
    return search.fuse_ranks(a, b).select("page", F.round("score", 9).alias("score"))


@query("similar_texts")
def similar_texts(s, d):
    return search.similar(search.fingerprints(read(s, d, "part").select(S("p_partkey").alias("page"), F.col("p_name").alias("text"))), "small widget", 20)


@query("stale_chunks", "SELECT CAST(c_custkey AS VARCHAR) AS path, 0 AS idx FROM customer WHERE c_custkey % 4 IN (1, 2)")
def stale_chunks(s, d):
    c = read(s, d, "customer")
    new = c.select(S("c_custkey").alias("path"), F.lit(0).alias("idx"), F.md5("c_name").alias("content_hash"))
    old = c.filter("c_custkey % 4 <> 1").select(S("c_custkey").alias("path"), F.lit(0).alias("idx"), F.when(F.col("c_custkey") % 4 == 2, "x").otherwise(F.md5("c_name")).alias("content_hash"))
    return search.stale_chunks(new, old)


@query("embeddings_reused", "SELECT n, count(*) AS chunks FROM (SELECT (SELECT min(vec_id) FROM embeddings e WHERE e.vec_id = c_custkey AND e.vec_id % 2 = 0) IS NULL AS n FROM customer) GROUP BY 1")
def embeddings_reused(s, d):
    known = read(s, d, "embeddings").filter("vec_id % 2 = 0").select(F.md5(S("vec_id")).alias("content_hash"), "embedding")
    return search.embed_missing(read(s, d, "customer").select(F.md5(S("c_custkey")).alias("content_hash")), known).groupBy(F.col("embedding").isNull().alias("n")).agg(F.count("*").alias("chunks"))


@query("near_filter", f"WITH {model.GRAPH} SELECT DISTINCT page FROM pages_ WHERE page = 'nation:3' OR page IN (SELECT source FROM edges_ WHERE target = 'nation:3') OR page IN (SELECT target FROM edges_ WHERE source = 'nation:3')")
def near_filter(s, d):
    e = model.edges(s, d)
    from ..operators.iterate import neighbourhood

    return search.near(model.pages(s, d).select("page"), neighbourhood(e, "nation:3", 1))


# the predicate language

_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


@query("predicate_language", f"""SELECT event_id, {_K} > 50 AS above, {_K} = 87 OR NOT ({_K} <= 90) AS either, true AS absent, false AS typed, true AS not_null, {_K} % 1 = 0 AND {_K} >= 0 AND {_K} < 20 AS span FROM events""")
def predicate_language(s, d):
    p = lambda text, n: predicate.compile(text, F.col("props")).alias(n)
    return read(s, d, "events").select("event_id", p("k > 50", "above"), p("k == 87 || !(k <= 90)", "either"), p("missing.path[-1] != 3 && missing is null", "absent"), p("k == '87' || k > 'a'", "typed"), p("k is not null", "not_null"), p("k >= 0 && (k < 20)", "span"))


@query("selector", "SELECT page_id FROM pages WHERE (url LIKE '%example.net/%' OR url LIKE '%example.com/%') AND url NOT LIKE '%/de/%' AND (contains(html, 'the') OR regexp_matches(html, '<h1>[A-Z]'))")
def selector(s, d):
    pages = read(s, d, "pages").withColumn("meta", F.lit('{"draft": false, "tags": ["a"]}'))
    keep = predicate.selector(["*example.net/*", "*example.{com}/*"], ["*/de/*"], "draft == false && tags contains 'a'", ["the", "re:<h1>[A-Z]"], path="url", metadata="meta", text="html")
    return keep(pages).select("page_id")


@query("hook_coverage", "SELECT 'net' AS hook, count(*) FILTER (WHERE url LIKE '%example.net/%') AS matched, count(*) AS total FROM pages UNION ALL SELECT 'all', count(*), count(*) FROM pages")
def hook_coverage(s, d):
    sel = lambda g: predicate.selector([g], path="url")
    return predicate.coverage(read(s, d, "pages"), {"net": sel("*example.net/*"), "all": sel("**")}).withColumn("total", F.col("total").cast("long"))


# history

D = model.DAYS


def _snapshots(s, d):
    return model.days(s, d).select("seq").distinct()


@query("vault_history", f"""WITH {D}, t AS (SELECT seq, count(DISTINCT page) AS total_pages, count(target) AS total_links FROM days_ GROUP BY 1), n AS (SELECT *, lag(seq) OVER (ORDER BY seq) AS before, lag(total_links) OVER (ORDER BY seq) AS was FROM t), p AS (SELECT DISTINCT seq, page FROM days_)
    SELECT seq, total_pages, total_links, CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM p WHERE p.seq = n.seq AND page NOT IN (SELECT page FROM p WHERE p.seq = n.before)) END AS pages_added,
    CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM p WHERE p.seq = n.before AND page NOT IN (SELECT page FROM p WHERE p.seq = n.seq)) END AS pages_removed, greatest(total_links - coalesce(was, total_links), 0) AS links_added, greatest(coalesce(was, total_links) - total_links, 0) AS links_removed FROM n""")
def vault_history(s, d):
    return history.vault_history(_snapshots(s, d), model.days(s, d))


@query("page_history", f"""WITH {D}, st AS (SELECT page, seq, list_sort(list(DISTINCT target)) AS t FROM days_ GROUP BY 1, 2), grid AS (SELECT b.page, q.seq FROM (SELECT page, min(seq) AS born FROM st GROUP BY 1) b JOIN (SELECT DISTINCT seq FROM days_) q ON q.seq >= b.born),
    f AS (SELECT g.page, g.seq, st.t, lag(st.t) OVER (PARTITION BY g.page ORDER BY g.seq) AS o FROM grid g LEFT JOIN st ON st.page = g.page AND st.seq = g.seq)
    SELECT page, seq, CASE WHEN o IS NULL THEN 'appeared' WHEN t IS NULL THEN 'disappeared' ELSE 'changed' END AS event, len(list_filter(coalesce(t, []), lambda x: NOT list_contains(coalesce(o, []), x))) AS added, len(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(t, []), x))) AS removed
    FROM f WHERE (o IS NULL AND t IS NOT NULL) OR (o IS NOT NULL AND t IS NULL) OR o <> t""")
def page_history(s, d):
    return history.page_history(_snapshots(s, d), model.days(s, d)).select("page", "seq", "event", F.size("added").alias("added"), F.size("removed").alias("removed"))


_FILES = f"{D}, files AS (SELECT seq, page, md5(string_agg(target, ',' ORDER BY target)) AS root_hash FROM days_ GROUP BY 1, 2)"


def _files(s, d):
    return model.days(s, d).groupBy("seq", "page").agg(F.md5(F.array_join(F.sort_array(F.collect_set("target")), ",")).alias("root_hash"))


@query("recent_changes", f"""WITH {_FILES}, q AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS before FROM (SELECT DISTINCT seq FROM files)), a AS (SELECT q.seq, page, root_hash FROM q JOIN files f ON f.seq = q.seq WHERE before IS NOT NULL), b AS (SELECT q.seq, page, root_hash FROM q JOIN files f ON f.seq = q.before)
    SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.page, b.page) AS page, CASE WHEN b.page IS NULL THEN 'added' WHEN a.page IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.seq = b.seq AND a.page = b.page WHERE a.root_hash IS DISTINCT FROM b.root_hash""")
def recent_changes(s, d):
    return history.recent_changes(_files(s, d))


@query("graph_diff", f"""WITH {D}, o AS (SELECT page, target FROM days_ WHERE seq = 3), n AS (SELECT page, target FROM days_ WHERE seq = 10)
    SELECT 'page_removed' AS change, page AS a, NULL AS b FROM (SELECT page FROM o EXCEPT SELECT page FROM n) UNION ALL SELECT 'page_added', page, NULL FROM (SELECT page FROM n EXCEPT SELECT page FROM o)
    UNION ALL SELECT 'link_removed', page, target FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'link_added', page, target FROM (SELECT * FROM n EXCEPT SELECT * FROM o)
    UNION ALL SELECT 'orphan_resolved', page, NULL FROM (SELECT page FROM o EXCEPT SELECT page FROM n) UNION ALL SELECT 'orphan_gained', page, NULL FROM (SELECT page FROM n EXCEPT SELECT page FROM o)
    UNION ALL SELECT 'dead_resolved', page, target FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'dead_gained', page, target FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def graph_diff(s, d):
    at = lambda k: model.days(s, d).filter(F.col("seq") == k).select(F.col("page").alias("source"), "target")
    old, new = at(3), at(10)
    return graph.graph_diff(old, old.select(F.col("source").alias("page")).distinct(), new, new.select(F.col("source").alias("page")).distinct())


@query("collapse_timeline", f"WITH {_FILES} SELECT max(seq) AS seq, page, root_hash AS vault_root_hash FROM files GROUP BY page, root_hash")
def collapse_timeline(s, d):
    f = _files(s, d).select(F.col("seq").alias("ts"), F.concat_ws("|", "page", "root_hash").alias("vault_root_hash"), "page", "root_hash")
    return history.collapse(f).select(F.col("ts").alias("seq"), "page", F.col("root_hash").alias("vault_root_hash"))


@query("snapshots_as_of", "SELECT e.event_id, p.change_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, 'c' || event_id AS change_id FROM events WHERE event_type = 'signup') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def snapshots_as_of(s, d):
    e = read(s, d, "events")
    snaps = e.filter("event_type = 'signup'").select("user_id", "ts", F.concat(F.lit("c"), S("event_id")).alias("change_id"))
    return history.as_of(e.select("user_id", "ts", "event_id"), snaps, "user_id").select("event_id", "change_id")


_SNAP = "s AS (SELECT 'c' || event_id AS change_id, ts FROM events WHERE event_type = 'signup')"


def _snap(s, d):
    return read(s, d, "events").filter("event_type = 'signup'").select(F.concat(F.lit("c"), S("event_id")).alias("change_id"), "ts")


@query("snapshot_at", f"WITH {_SNAP} SELECT 'date' AS asked, arg_max(change_id, ts) AS change_id FROM s WHERE ts <= TIMESTAMP '2024-01-15 23:59:59' UNION ALL SELECT 'head', (SELECT change_id FROM s ORDER BY ts DESC LIMIT 1 OFFSET 3)")
def snapshot_at(s, d):
    one = lambda n, text: history.resolve_snapshot(_snap(s, d), text, NOW).select(F.lit(n).alias("asked"), "change_id")
    return one("date", "2024-01-15").unionByName(one("head", "HEAD~3"))


@query("timeline_since", f"WITH {_SNAP} SELECT change_id FROM s WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def timeline_since(s, d):
    kind, value = dates.parse_time("7 days ago", NOW)
    return history.since(_snap(s, d), kind, value).select("change_id")


@query("link_since", f"WITH {D} SELECT page, target, CAST(min(seq) AS INTEGER) AS since FROM days_ GROUP BY 1, 2")
def link_since(s, d):
    return history.link_since(_snapshots(s, d).withColumn("ts", F.col("seq")), model.days(s, d))


@query("trend_sample", f"WITH {D}, t AS (SELECT seq, count(DISTINCT page) AS total_pages, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM days_ GROUP BY 1) SELECT seq, total_pages FROM t WHERE i IN (SELECT j * (n - 1) // 9 FROM range(10) r(j))")
def trend_sample(s, d):
    return history.sample_trend(history.vault_history(_snapshots(s, d), model.days(s, d)), 10).select("seq", "total_pages")


@query("page_ages", "SELECT 'user:' || user_id AS page, date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-01') AS age_days, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS stable_days FROM events GROUP BY 1")
def page_ages(s, d):
    e = read(s, d, "events").select(F.concat(F.lit("user:"), S("user_id")).alias("page"), "ts")
    return history.page_ages(e, NOW).select("page", F.col("age_days").cast("long"), F.col("stable_days").cast("long"))


@query("history_stats", "SELECT count(*) AS snapshots, count(DISTINCT event_type) AS distinct_hashes, min(ts) AS first, max(ts) AS last FROM events")
def history_stats(s, d):
    return history.history_stats(read(s, d, "events").select("ts", F.col("event_type").alias("vault_root_hash")))


@query("object_changes", """WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS object_id, 'p/' || p_brand AS path, p_size AS h FROM part WHERE p_partkey % 5 <> 0), o AS (SELECT CAST(p_partkey AS VARCHAR) AS object_id, CASE WHEN p_partkey % 7 = 0 THEN 'q/' ELSE 'p/' END || p_brand AS path, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size END AS h FROM part WHERE p_partkey % 4 <> 0),
    x AS (SELECT coalesce(n.object_id, o.object_id) AS object_id, CASE WHEN o.object_id IS NULL THEN 'added' WHEN n.object_id IS NULL THEN 'deleted' WHEN n.path <> o.path THEN 'moved' WHEN n.h <> o.h THEN 'updated' END AS change, coalesce(n.path, o.path) AS path FROM n FULL JOIN o ON n.object_id = o.object_id)
    SELECT 99 + row_number() OVER (ORDER BY change = 'deleted', object_id) AS seq, * FROM x WHERE change IS NOT NULL""")
def object_changes(s, d):
    p = read(s, d, "part")
    new = p.filter("p_partkey % 5 <> 0").select(S("p_partkey").alias("object_id"), F.concat(F.lit("p/"), "p_brand").alias("path"), F.col("p_size").alias("hash"))
    old = p.filter("p_partkey % 4 <> 0").select(S("p_partkey").alias("object_id"), F.concat(F.expr("case when p_partkey % 7 = 0 then 'q/' else 'p/' end"), "p_brand").alias("path"), F.expr("case when p_partkey % 3 = 0 then -1 else p_size end").alias("hash"))
    return history.object_changes(old, new, 100).select("seq", "object_id", "change", "path")


# content hashes


def _leaves(s, d):
    return read(s, d, "lineitem").groupBy(S("l_orderkey").alias("path"), "l_linenumber").agg(F.min("l_partkey").alias("p")).select("path", (F.col("l_linenumber") - 1).alias("pos"), F.expr("case when l_linenumber % 4 = 1 then 'heading' when l_linenumber % 4 = 3 then 'rules' else 'paragraph' end").alias("type"), F.expr("cast(case when l_linenumber % 4 = 1 then 1 + p % 3 end as int)").alias("level"), S("p").alias("text"), F.sha2(S("p"), 256).alias("hash"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.expr("case when p % 5 = 0 then 'b' || p end").alias("block_id"))


_LEAVES = """leaves AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber - 1 AS pos, CASE WHEN l_linenumber % 4 = 1 THEN 'heading' WHEN l_linenumber % 4 = 3 THEN 'rules' ELSE 'paragraph' END AS type, CASE WHEN l_linenumber % 4 = 1 THEN 1 + p % 3 END AS level, sha256(CAST(p AS VARCHAR)) AS hash, CASE WHEN p % 5 = 0 THEN 'b' || p END AS block_id
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2))"""


@query("file_roots", f"WITH {_LEAVES} SELECT path, sha256(string_agg(hash, chr(10) ORDER BY pos)) AS root_hash FROM leaves GROUP BY 1")
def file_roots(s, d):
    return merkle.file_roots(_leaves(s, d))


_PARTS = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(8))


@query("vault_root", f"WITH {_LEAVES}, each AS (SELECT sha256(path || chr(10) || sha256(string_agg(hash, chr(10) ORDER BY pos))) AS h FROM leaves GROUP BY path) SELECT count(*) AS files, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_PARTS})) AS vault_root_hash FROM each")
def vault_root(s, d):
    return merkle.vault_root(merkle.file_roots(_leaves(s, d)))


@query("sections", f"""WITH {_LEAVES}, h AS (SELECT path, pos, level FROM leaves WHERE type = 'heading'), n AS (SELECT path, max(pos) + 1 AS n, min(pos) FILTER (WHERE type = 'heading') AS h0 FROM leaves GROUP BY 1)
    SELECT h.path, CAST(row_number() OVER (PARTITION BY h.path ORDER BY pos) AS INTEGER) AS section, CAST(pos AS INTEGER) AS first, CAST(coalesce((SELECT min(b.pos) FROM h b WHERE b.path = h.path AND b.pos > h.pos AND b.level <= h.level), n) - 1 AS INTEGER) AS last FROM h JOIN n USING (path)
    UNION ALL SELECT path, 0, 0, CAST(coalesce(h0, n) - 1 AS INTEGER) FROM n WHERE h0 IS NULL OR h0 > 0""")
def sections(s, d):
    return merkle.sections(_leaves(s, d)).select("path", "section", F.col("first").cast("int"), F.col("last").cast("int"))


_GROUND = f"""{_LEAVES}, r AS (SELECT path, pos, hash, (SELECT max(pos) FROM leaves h WHERE h.path = l.path AND h.type = 'heading' AND h.pos <= l.pos) AS h FROM leaves l WHERE type = 'rules'),
    e AS (SELECT r.*, coalesce((SELECT min(b.pos) FROM leaves b JOIN leaves a ON a.path = b.path AND a.pos = r.h WHERE b.path = r.path AND b.type = 'heading' AND b.pos > r.h AND b.level <= a.level), (SELECT max(pos) + 1 FROM leaves x WHERE x.path = r.path)) AS stop,
        coalesce((SELECT min(pos) FROM leaves x WHERE x.path = r.path AND x.type = 'heading'), (SELECT max(pos) + 1 FROM leaves x WHERE x.path = r.path)) AS h0 FROM r),
    g AS (SELECT path, pos, hash AS ast_hash, (SELECT sha256(string_agg(hash, chr(10) ORDER BY pos)) FROM leaves x WHERE x.path = e.path AND x.type <> 'rules' AND CASE WHEN e.h IS NULL THEN x.pos < e.h0 ELSE x.pos >= e.h AND x.pos < e.stop END) AS grounding FROM e)"""


@query("groundings", f"WITH {_GROUND} SELECT path, CAST(pos AS INTEGER) AS pos, ast_hash, grounding FROM g")
def groundings(s, d):
    return merkle.groundings(_leaves(s, d)).select("path", F.col("pos").cast("int"), "ast_hash", "grounding")


@query("grounding_drift", f"WITH {_GROUND} SELECT path, CAST(pos + 1 AS INTEGER) AS start_line, ast_hash FROM g WHERE CAST(path AS INTEGER) % 3 = 1 AND grounding IS NOT NULL")
def grounding_drift(s, d):
    now = merkle.groundings(_leaves(s, d))
    key = F.col("path").cast("int") % 3
    old = now.withColumn("ast_hash", F.when(key == 2, "x").otherwise(F.col("ast_hash"))).withColumn("grounding", F.when((key >= 1) & F.col("grounding").isNotNull(), "y").otherwise(F.col("grounding")))
    return merkle.drift(now, old).withColumn("start_line", F.col("start_line").cast("int"))


@query("block_id_lookup", f"WITH {_LEAVES}, q AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS path, 'b' || (o_custkey % 20 * 5) AS block_id FROM orders) SELECT q.path, q.block_id, arg_min(l.hash, l.pos) AS hash FROM q LEFT JOIN leaves l ON l.path = q.path AND l.block_id = q.block_id GROUP BY 1, 2")
def block_id_lookup(s, d):
    q = read(s, d, "orders").select(S("o_orderkey").alias("path"), F.concat(F.lit("b"), S_expr("o_custkey % 20 * 5")).alias("block_id")).distinct()
    return merkle.resolve_block_ids(q, _leaves(s, d)).select("path", "block_id", "hash")


def S_expr(e):  # noqa: N802
    return F.expr(f"cast({e} as string)")


@query("hash_prefixes", f"WITH {_LEAVES}, q AS (SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 10) AS prefix FROM part) SELECT prefix, count(DISTINCT hash) AS n_hashes, CASE count(DISTINCT hash) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM q LEFT JOIN leaves ON substr(hash, 1, 10) = prefix GROUP BY 1")
def hash_prefixes(s, d):
    q = read(s, d, "part").select(F.substring(F.sha2(S("p_partkey"), 256), 1, 10).alias("prefix"))
    return merkle.resolve_prefixes(q, _leaves(s, d)).select("prefix", "n_hashes", "status")


@query("enclosing_spans", "SELECT e.event_id, o.span FROM events e LEFT JOIN (SELECT user_id, (event_id // 100) * 100 AS lo, (event_id // 100) * 100 + 49 AS hi, min(event_id) AS span FROM events GROUP BY ALL) o ON o.user_id = e.user_id AND e.event_id BETWEEN o.lo AND o.hi")
def enclosing_spans(s, d):
    e = read(s, d, "events")
    spans = e.groupBy(S("user_id").alias("path"), (F.floor(F.col("event_id") / 100) * 100).alias("start_line")).agg(F.min("event_id").alias("span")).withColumn("end_line", F.col("start_line") + 49)
    return merkle.enclosing(e.select(S("user_id").alias("path"), F.col("event_id").alias("line")), spans).select(F.col("line").alias("event_id"), "span")


# sources


@query("cache_states", "SELECT CAST(c_custkey AS VARCHAR) || '.md' AS path, CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'hit' WHEN 2 THEN 'unchanged' ELSE 'reparse' END AS state FROM customer")
def cache_states(s, d):
    c = read(s, d, "customer").withColumn("k", F.col("c_custkey") % 5)
    path = F.concat(S("c_custkey"), F.lit(".md")).alias("path")
    now = c.select(path, F.lit(2).alias("mtime"), F.md5("c_name").alias("root_hash"))
    old = c.filter("k > 0").select(path, F.when(F.col("k").isin(1, 4), 2).otherwise(1).alias("mtime"), F.when(F.col("k") == 3, "x").when(F.col("k") < 3, F.md5("c_name")).alias("root_hash"))
    return vault.changed(now, old)


@query("scan_exclusions", "SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 5)")
def scan_exclusions(s, d):
    path = F.expr("case p_partkey % 6 when 0 then 'a/' || p_partkey || '.md' when 1 then '.git/' || p_partkey || '.md' when 2 then 'x/.hidden/' || p_partkey || '.md' when 3 then 'assets/' || p_partkey || '.md' when 4 then 'drafts/' || p_partkey || '.md' else '.kept/' || p_partkey || '.spl' end")
    p = read(s, d, "part").select("p_partkey", path.alias("path"))
    return vault.scanned(p.unionByName(p.withColumn("path", F.concat("path", F.lit(".png")))), exclude=("drafts/",), whitelist=(".kept",)).select("p_partkey")


@query("cache_eviction", "SELECT event_type || user_id AS vault_root_hash FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 100")
def cache_eviction(s, d):
    return vault.newest(read(s, d, "events").select(F.concat("event_type", S("user_id")).alias("vault_root_hash"), F.col("ts").alias("used_at"))).select("vault_root_hash")


# feeds


def _items(s, d):
    return read(s, d, "orders").select(S("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit("/"), S("o_orderkey")).alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"), (F.col("o_orderstatus") == "O").alias("opt_in"), F.array("o_orderstatus").alias("tags"), S("o_custkey").alias("subscription"), (F.col("o_orderkey") % 11 == 0).alias("pinned"), (F.col("o_orderkey") % 2 == 0).alias("archivable"))


_I = "items AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || '/' || o_orderkey AS path, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_published, o_orderstatus = 'O' AS opt_in, o_orderstatus AS tag, CAST(o_custkey AS VARCHAR) AS subscription, o_orderkey % 11 = 0 AS pinned, o_orderkey % 2 = 0 AS archivable FROM orders)"


@query("feed_items", f"WITH {_I} SELECT id, date_published FROM items WHERE opt_in ORDER BY date_published DESC, id LIMIT 50")
def feed_items(s, d):
    return feed.select_items(_items(s, d), feed.matches_rule("opt_in")).select("id", "date_published")


@query("feed_by_tag", f"WITH {_I} SELECT id FROM items WHERE tag = 'F' AND starts_with(path, (SELECT min(o_orderpriority) FROM orders) || '/') ORDER BY date_published DESC, id LIMIT 20")
def feed_by_tag(s, d):
    folder = read(s, d, "orders").agg(F.min("o_orderpriority")).first()[0]
    return feed.select_items(_items(s, d), feed.matches_rule("tag", "F") & feed.matches_rule("folder", folder), 20).select("id")


@query("feed_scopes", f"WITH {_I} SELECT scope, rank, id FROM (SELECT o.p AS scope, CAST(row_number() OVER (PARTITION BY o.p ORDER BY date_published DESC, id) AS INTEGER) AS rank, id FROM items JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) o ON starts_with(path, o.p || '/')) WHERE rank <= 50")
def feed_scopes(s, d):
    scopes = read(s, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.concat("o_orderpriority", F.lit("/")).alias("prefix")).distinct()
    return feed.scoped(_items(s, d), scopes)


@query("retention_by_count", f"WITH {_I} SELECT id, CASE WHEN k <= 3 OR pinned THEN 'keep' WHEN archivable THEN 'archive' ELSE 'delete' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY subscription ORDER BY date_published DESC, id) AS k FROM items)")
def retention_by_count(s, d):
    return feed.retention_plan(_items(s, d), "last-3", "1998-12-31T00:00:00Z").select("id", "action")


@query("retention_by_age", f"WITH {_I} SELECT id, CASE WHEN date_published >= strftime(TIMESTAMP '1998-12-31 00:00:00' - INTERVAL 730 DAY, '%Y-%m-%dT%H:%M:%SZ') OR pinned THEN 'keep' WHEN archivable THEN 'archive' ELSE 'delete' END AS action FROM items")
def retention_by_age(s, d):
    return feed.retention_plan(_items(s, d), "2y", "1998-12-31T00:00:00Z").select("id", "action")


@query("seen_items", "SELECT o_orderkey, o_orderkey % 3 = 0 OR o_custkey % 10 = 0 AS seen FROM orders")
def seen_items(s, d):
    o = read(s, d, "orders")
    items = o.select("o_orderkey", S("o_orderkey").alias("guid"), F.concat(F.lit("c"), S("o_custkey")).alias("link"), F.lit("").alias("hash"))
    known = o.filter("o_orderkey % 3 = 0").select(S("o_orderkey").alias("guid"), F.lit("").alias("link"), F.lit("").alias("hash")).unionByName(o.filter("o_custkey % 10 = 0").select(F.lit("").alias("guid"), F.concat(F.lit("c"), S("o_custkey")).alias("link"), F.lit("").alias("hash")))
    return feed.seen_before(items, known).select("o_orderkey", "seen")


@query("forget_plan", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'erase' ELSE 'remove' END AS action FROM orders WHERE o_orderstatus = 'P' OR CAST(o_orderkey AS VARCHAR) LIKE '12%'")
def forget_plan(s, d):
    o = read(s, d, "orders").select(S("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit("/"), S("o_orderkey")).alias("path"), S("o_orderkey").alias("guid"), F.lit("").alias("hash"), (F.col("o_orderkey") % 2 == 0).alias("archived"))
    return feed.forget_plan(o, "P/*", "12")


_LIC = "(CASE o_orderkey % 7 WHEN 0 THEN 'CC0-1.0' WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'CC-BY-SA-4.0' WHEN 3 THEN 'CC-BY-NC-4.0' WHEN 4 THEN 'CC-BY-ND-4.0' WHEN 5 THEN 'MIT' ELSE ' ' END)"


@query("republication", f"""SELECT o_orderkey, CASE WHEN NOT pub THEN 'deny' WHEN l = 'CC0-1.0' THEN 'full' WHEN l = 'CC-BY-4.0' THEN mode WHEN l = 'CC-BY-SA-4.0' THEN CASE WHEN o_orderkey % 3 = 0 THEN mode ELSE 'excerpt' END WHEN l = 'CC-BY-NC-4.0' THEN CASE WHEN o_orderkey % 2 = 0 THEN mode ELSE 'excerpt' END WHEN l = 'CC-BY-ND-4.0' THEN 'excerpt' WHEN ok THEN mode ELSE 'deny' END AS mode
    FROM (SELECT o_orderkey, {_LIC} AS l, o_orderkey % 5 <> 0 AS pub, CASE WHEN o_orderkey % 11 < 6 THEN 'full' ELSE 'excerpt' END AS mode, o_orderkey % 13 < 5 AS ok FROM orders)""")
def republication(s, d):
    k = F.col("o_orderkey")
    mode, _ = feed.republication(feed.license_of(F.expr(_LIC)), k % 5 != 0, F.when(k % 11 < 6, "full").otherwise("excerpt"), F.when(k % 3 == 0, "CC-BY-SA-4.0"), k % 2 != 0, k % 13 < 5)
    return read(s, d, "orders").select("o_orderkey", mode.alias("mode"))


@query("licenses", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'CC-BY-SA-4.0' WHEN 2 THEN 'CC0-1.0' ELSE 'NOASSERTION' END AS license FROM orders")
def licenses(s, d):
    k = F.col("o_orderkey") % 4
    return read(s, d, "orders").select("o_orderkey", feed.resolve_license(F.when(k == 0, "MIT").otherwise("NOASSERTION"), F.when(k == 1, "https://creativecommons.org/licenses/by-sa/4.0/"), [F.when(k == 2, "see http://creativecommons.org/publicdomain/zero/1.0/"), F.lit("all rights")]).alias("license"))


@query("rewritten_links", """SELECT 'c' || c_custkey AS path, 'In <a href="/n/' || lower(n_name) || '">home</a> and ghost' || c_custkey || '.' AS html FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def rewritten_links(s, d):
    c, n = read(s, d, "customer"), read(s, d, "nation")
    pages = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("c"), S("c_custkey")).alias("path"), F.concat(F.lit("In [["), "n_name", F.lit("|home]] and [[ghost"), S("c_custkey"), F.lit("]].")).alias("content"))
    return feed.rewrite_links(pages, n.select(F.col("n_name").alias("page"), F.lower("n_name").alias("slug")), "/n/")


# access


@query("cohorts", "SELECT 'own' AS cohort, c_name AS slug FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'odd', c_name FROM customer WHERE c_custkey % 4 <> 0 AND regexp_matches(c_name, '[13579]$') UNION ALL SELECT 'all', c_name FROM customer WHERE c_custkey % 4 <> 0")
def cohorts(s, d):
    return access.cohort_pages(_cohort_pages(s, d), _cohorts(s))


def _cohort_pages(s, d):
    return read(s, d, "customer").select(F.col("c_name").alias("slug"), F.expr("case when c_custkey % 4 = 0 then array('own', 'gone') end").alias("cohorts"))


def _cohorts(s):
    return s.createDataFrame([("own", "^$"), ("odd", "[13579]$"), ("all", None)], "cohort string, pattern string")


@query("cohort_backlinks", "WITH t AS (SELECT c_name FROM customer WHERE c_custkey = 1), m AS (SELECT 'odd' AS cohort, c_name AS slug FROM customer WHERE c_custkey % 4 <> 0 AND regexp_matches(c_name, '[13579]$') UNION ALL SELECT 'all', c_name FROM customer WHERE c_custkey % 4 <> 0) SELECT DISTINCT m.cohort, m.slug AS source FROM m JOIN customer c ON c.c_name = m.slug WHERE m.cohort IN (SELECT cohort FROM m WHERE slug IN (SELECT c_name FROM t))")
def cohort_backlinks(s, d):
    c = read(s, d, "customer")
    one = c.filter("c_custkey = 1").first()
    target = one["c_name"] if one else ""
    e = c.select(F.col("c_name").alias("source"), F.lit(target).alias("target"))
    return access.scoped_backlinks(e, access.cohort_pages(_cohort_pages(s, d), _cohorts(s)), target)


def _acl(s, d):
    c = read(s, d, "customer")
    users = c.filter("c_custkey % 7 <> 6").select(F.col("c_name").alias("user"), F.expr("case c_custkey % 3 when 0 then 'admin' when 1 then 'editor' else 'reader' end").alias("role"), (F.col("c_custkey") % 50 == 0).alias("owner"), (F.col("c_custkey") % 4 == 0).alias("agent"))
    scopes = c.select(F.col("c_name").alias("user"), F.lit("^docs/").alias("pattern"))
    asked = c.select(F.col("c_name").alias("user"), F.explode(F.array(F.lit("docs/a"), F.lit("other"), F.lit("access"))).alias("page"), F.lit("edit").alias("action"))
    return asked.unionByName(asked.withColumn("action", F.lit("read"))), users, scopes


_ACL = """acl AS (SELECT c_name AS "user", page, action, CASE WHEN c_custkey % 7 = 6 THEN false ELSE c_custkey % 50 = 0 END AS own, c_custkey % 7 <> 6 AND (c_custkey % 3 = 0 OR c_custkey % 50 = 0) AS admin, c_custkey % 7 <> 6 AND c_custkey % 3 = 1 AND page LIKE 'docs/%' AS editor, c_custkey % 7 <> 6 AND c_custkey % 4 = 0 AND page = 'access' AS barred
    FROM customer, (VALUES ('docs/a'), ('other'), ('access')) p(page), (VALUES ('edit'), ('read')) q(action))"""


@query("access_decisions", f"""WITH {_ACL} SELECT "user", page, action, own OR action = 'read' OR ((admin OR editor) AND NOT barred) AS allowed, CASE WHEN own THEN '+D' WHEN action = 'read' OR ((admin OR editor) AND NOT barred) THEN '+d' ELSE '-d' END AS tag FROM acl""")
def access_decisions(s, d):
    return access.decide(*_acl(s, d))


@query("access_overlay", f"""WITH {_ACL} SELECT page, count(*) AS n FROM acl WHERE action = 'read' AND page <> 'other' GROUP BY 1""")
def access_overlay(s, d):
    asked, users, scopes = _acl(s, d)
    ban = asked.filter("page = 'other'").select("user", "page", "action", F.lit("+d").alias("tag"))
    return access.apply_overlay(access.decide(asked, users, scopes), ban).filter("action = 'read' and allowed").groupBy("page").agg(F.count("*").alias("n"))


@query("access_violations", f"""WITH {_ACL} SELECT "user", page, action, false AS allowed, '-d' AS tag FROM acl WHERE action = 'edit' AND NOT (own OR ((admin OR editor) AND NOT barred))""")
def access_violations(s, d):
    asked, users, scopes = _acl(s, d)
    return access.violations(asked.filter("action = 'edit'"), users, scopes)


@query("access_reasoned", f"""WITH {_ACL} SELECT "user", page, action, own OR action = 'read' OR ((admin OR editor) AND NOT barred) AS allowed, CASE WHEN own THEN '+D' WHEN action = 'read' OR ((admin OR editor) AND NOT barred) THEN '+d' ELSE '-d' END AS tag FROM acl""")
def access_reasoned(s, d):
    return access.evaluate(*_acl(s, d))


@query("grant_states", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN e AND r THEN 'expired_revoked' WHEN e THEN 'expired' WHEN r THEN 'revoked' ELSE 'active' END AS state FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') <= '1996-01-01' AS e, o_orderkey % 3 = 0 AS r FROM orders)) GROUP BY 1")
def grant_states(s, d):
    g = read(s, d, "orders").select(S("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expires_at"), (F.col("o_orderkey") % 3 == 0).alias("revoked"))
    return access.grant_states(g, "1996-01-01").groupBy("state").agg(F.count("*").alias("n"))


@query("visible_pages", "SELECT c_name AS slug FROM customer WHERE c_custkey % 9 <> 0")
def visible_pages(s, d):
    c = read(s, d, "customer")
    return access.visible(c.select(F.col("c_name").alias("slug")), c.filter("c_custkey % 9 = 0").select(F.col("c_name").alias("slug")))


# written forms and whole searches


@query("export_counts", f"WITH {model.GRAPH} SELECT (SELECT count(*) FROM (SELECT page FROM pages_ UNION SELECT source FROM edges_ UNION SELECT target FROM edges_)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM edges_)) AS edges")
def export_counts(s, d):
    rows = export.graph_json(model.edges(s, d), model.pages(s, d)).filter("part = 'counts'")
    return rows.select(F.from_json("value", "nodes long, edges long").alias("v")).select("v.*")


@query("index_json_rows", f"WITH {model.GRAPH} SELECT 'node' AS part, count(DISTINCT page) AS n FROM pages_ UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT source, target, predicate FROM edges_)")
def index_json_rows(s, d):
    return export.index_json(model.edges(s, d), model.pages(s, d)).groupBy("part").agg(F.count("*").alias("n"))


@query("history_json_rows", f"WITH {model.DAYS} SELECT 'vault' AS part, least(10, count(DISTINCT seq)) AS n FROM days_ UNION ALL SELECT 'page', count(DISTINCT page) FROM days_")
def history_json_rows(s, d):
    return export.history_json(_snapshots(s, d), model.days(s, d)).groupBy("part").agg(F.count("*").alias("n"))


@query("feed_catalog", f"WITH {_I} SELECT o_orderpriority AS scope, o_orderpriority || '/' AS prefix, count(*) AS items FROM orders GROUP BY 1, 2")
def feed_catalog(s, d):
    scopes = read(s, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.concat("o_orderpriority", F.lit("/")).alias("prefix")).distinct()
    return export.catalog(scopes, _items(s, d))


@query("full_text_hits", r"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents),
    sizes AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t), tf AS (SELECT doc_id, text, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'nicht')) AS tf FROM t),
    scored AS (SELECT doc_id, text, (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM sizes, (SELECT count(*) AS df FROM tf WHERE tf > 0)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM sizes))) AS score FROM tf WHERE tf > 0),
    lines AS (SELECT *, unnest(string_split(text, chr(10))) AS line_, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM scored),
    heads AS (SELECT *, max(CASE WHEN n % 3 = 1 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS h FROM lines)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(n AS INTEGER) AS line, CAST(strpos(lower(line_), 'nicht') AS INTEGER) AS "column", substr(line_, greatest(strpos(lower(line_), 'nicht') - 40, 1), strpos(lower(line_), 'nicht') - greatest(strpos(lower(line_), 'nicht') - 40, 1) + 45) AS context,
        'line ' || h AS heading, CAST(1 + h % 2 AS INTEGER) AS heading_level, round(score, 5) AS score FROM heads WHERE strpos(lower(line_), 'nicht') > 0""")
def full_text_hits(s, d):
    """Every third line from the first counts as a heading."""
    pages = read(s, d, "documents").select(S("doc_id").alias("page"), S("doc_id").alias("path"), F.col("text").alias("content"))
    lines = pages.select("path", F.posexplode(F.split("content", "\n")).alias("n", "x")).filter("n % 3 = 0").select("path", (F.col("n") + 1).alias("line"))
    heads = lines.select("path", "line", F.concat(F.lit("line "), S("line")).alias("text"), (1 + F.col("line") % 2).alias("level"))
    return find.full_text(pages, heads, "nicht", None).drop("page").withColumn("score", F.round("score", 5))


@query("page_by_name", "SELECT n_name AS page, 0 AS distance FROM nation WHERE n_nationkey = 7")
def page_by_name(s, d):
    pages = read(s, d, "nation").select(F.col("n_name").alias("page"), F.concat("n_name", F.lit(".md")).alias("path"))
    return find.find_page(pages, "nation-7")


@query("mixed_parsers", "SELECT 'ledger' AS hook, CAST(o_orderkey AS VARCHAR) AS path, 'markdown' AS parser FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 1")
def mixed_parsers(s, d):
    pages = read(s, d, "orders").select(S("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 2 == 1, "markdown").otherwise("ledger").alias("parser"), F.to_json(F.struct("o_orderstatus")).alias("frontmatter"))
    picks = {"ledger": predicate.selector(["*"], where="o_orderstatus == 'P'")}
    return find.mixed_parsers(pages, picks, {"ledger": "ledger"})


# html


@query("html_domains", "SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS host FROM pages")
def html_domains(s, d):
    return html.domains(read(s, d, "pages").select("url"))


@query("html_urls", "SELECT page_id AS id, unnest(regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*\"([^\"]*)\"', 1)) AS url FROM pages")
def html_urls(s, d):
    return html.urls(read(s, d, "pages"))


@query("html_audit", "SELECT page_id AS id, url, CASE WHEN page_id % 10 = 0 THEN 'dynamic' WHEN page_id % 10 = 1 THEN 'dangerous' ELSE 'unseen_domain' END AS kind FROM (SELECT page_id, CASE page_id % 10 WHEN 0 THEN '{{' || url || '}}' WHEN 1 THEN 'javascript:' || page_id ELSE url END AS url FROM pages) WHERE page_id % 10 < 2 OR regexp_matches(url, '^https?://(www\\.)?[^/?#]*\\.org([/?#]|$)')")
def html_audit(s, d):
    p = read(s, d, "pages").select(F.col("page_id").alias("id"), F.expr("case page_id % 10 when 0 then '{{' || url || '}}' when 1 then 'javascript:' || page_id else url end").alias("url"))
    return html.audit(p, html.domains(read(s, d, "pages").select("url")).filter(~F.col("host").endswith(".org")))


@query("html_raw_tags", "SELECT id, tag, count(*) AS n FROM (SELECT page_id AS id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9-]*)', 1)) AS tag FROM pages) WHERE tag NOT IN ('a','p','b','i','em','strong','ul','ol','li','h1','h2','h3','h4','h5','h6','br','code','pre','blockquote','img','table','tr','td','th','span','div') GROUP BY 1, 2")
def html_raw_tags(s, d):
    return html.raw_tags(read(s, d, "pages"))


@query("fetch_gates", "SELECT page_id, starts_with(url, 'http') AS safe_scheme, true AS public_target, false AS no_entities, strlen(html) <= 2000 AS under_size FROM pages")
def fetch_gates(s, d):
    return html.fetch_gates(read(s, d, "pages").withColumnRenamed("html", "body"), 2000).select("page_id", "safe_scheme", "public_target", "no_entities", "under_size")


# merging


@query("last_writer_wins", "SELECT event_type AS ext, CAST(user_id AS VARCHAR) AS key, arg_max(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), event_id) AS value FROM events GROUP BY 1, 2")
def last_writer_wins(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("ext"), S("user_id").alias("key"), F.round(F.col("value") * 100).cast("long").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return merge.last_writer_wins(e)


@query("percentile_gate", "SELECT event_type AS hook, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95, quantile_disc(value, 0.95) <= 400 AS within FROM events GROUP BY 1")
def percentile_gate(s, d):
    return merge.budget_gate(read(s, d, "events").select(F.col("event_type").alias("hook"), F.col("value").alias("ms")), 400)


@query("tree_diff", "SELECT CAST(p_partkey AS VARCHAR) AS path, place, change FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['/0'] WHEN 1 THEN ['/0', '/0'] ELSE ['/1'] END) AS place, unnest(CASE p_partkey % 3 WHEN 0 THEN ['modified'] WHEN 1 THEN ['removed', 'added'] ELSE ['added'] END) AS change FROM part)")
def tree_diff(s, d):
    p = read(s, d, "part")
    old = p.select(S("p_partkey").alias("path"), F.lit('{"type": "doc", "children": [{"type": "text", "value": "a"}]}').alias("tree"))
    new = p.select(S("p_partkey").alias("path"), F.expr("""case p_partkey % 3 when 0 then '{"type": "doc", "children": [{"type": "text", "value": "b"}]}' when 1 then '{"type": "doc", "children": [{"type": "code", "value": "a"}]}' else '{"type": "doc", "children": [{"type": "text", "value": "a"}, {"type": "rule"}]}' end""").alias("tree"))
    return merge.tree_diff(old, new).select("path", "place", "change")


@query("hook_pipeline", "SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE lower(c_name) || '!' END AS content, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS failed FROM customer")
def hook_pipeline(s, d):
    def shout(text, page):
        if page.metadata["k"] == 0:
            raise ValueError("no")
        page.emit("n", len(text))
        return text + "!"

    pages = read(s, d, "customer").select(F.col("c_name").alias("path"), F.col("c_name").alias("content"), F.concat(F.lit('{"k": '), S_expr("c_custkey % 5"), F.lit("}")).alias("frontmatter"))
    own = [hooks.Hook("lower", "pre_parse", lambda t, page: t.lower()), hooks.Hook("shout", "pre_parse", shout)]
    return hooks.run_stage(pages, own, "pre_parse").select("path", "content", F.size("failed").alias("failed"))


# reasoning


def _theory(s, d):
    """Every nation has facts and rules: an exporter if it has suppliers, not one if it is small, unless preferred."""
    n, sup = read(s, d, "nation"), read(s, d, "supplier")
    has = n.join(sup.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi").select("n_nationkey", F.concat(F.lit("(given has-"), "n_nationkey", F.lit(")")).alias("t"))
    k = S("n_nationkey")
    rules = n.select("n_nationkey", F.concat(F.lit("(normally e"), k, F.lit(" has-"), k, F.lit(" exporter-"), k, F.lit(")\n(normally s"), k, F.lit(" small-"), k, F.lit(" (not exporter-"), k, F.lit("))\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("(given small-"), k, F.lit(")\n"))).otherwise(""), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("(prefer e"), k, F.lit(" s"), k, F.lit(")\n"))).otherwise(""), F.lit("(always t"), k, F.lit(" has-"), k, F.lit(" known-"), k, F.lit(")")).alias("t"))
    text = rules.unionByName(has).groupBy("n_nationkey").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("content"))
    return Theory.of_blocks(text.select(F.concat(F.lit("n"), k, F.lit(".md")).alias("path"), k.alias("page"), F.lit(0).alias("ord"), F.lit(1).alias("start_line"), "content"))


_TH = "th AS (SELECT n_nationkey AS k, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has, n_nationkey % 2 = 0 AS small, n_nationkey % 4 = 0 AS pref FROM nation)"


@query("conclusions", f"""WITH {_TH} SELECT 'exporter-' || k AS literal, CASE WHEN has AND (NOT small OR pref) THEN '+d' ELSE '-d' END AS tag FROM th UNION ALL SELECT 'known-' || k, CASE WHEN has THEN '+D' ELSE '-D' END FROM th
    UNION ALL SELECT '~exporter-' || k, CASE WHEN small AND NOT has THEN '+d' ELSE '-d' END FROM th""")
def conclusions(s, d):
    found = reason.conclusions(_theory(s, d))
    keep = F.col("literal").rlike("^~?exporter-") & F.col("tag").isin("+d", "-d") | F.col("literal").rlike("^known-") & F.col("tag").isin("+D", "-D")
    return found.filter(keep)


@query("theory_summary", f"WITH {_TH} SELECT CAST(count(*) FILTER (WHERE has) + count(*) FILTER (WHERE small) AS BIGINT) AS facts, count(*) AS strict_rules, 2 * count(*) AS defeasible_rules, 0 AS defeater_rules, count(*) FILTER (WHERE pref) AS superiority, count(*) AS files FROM th")
def theory_summary(s, d):
    t = _theory(s, d)
    return reason.summary(t, reason.conclusions(t)).select("facts", "strict_rules", "defeasible_rules", "defeater_rules", "superiority", "files")


@query("theory_conflicts", f"WITH {_TH} SELECT 'exporter-' || k AS literal, 'e' || k AS for_rule, 's' || k AS against_rule FROM th WHERE NOT pref")
def theory_conflicts(s, d):
    return reason.conflicts(_theory(s, d))


@query("theory_problems", f"WITH {_TH} SELECT 'unsupported_literal' AS kind, 'has-' || k AS what FROM th WHERE NOT has UNION ALL SELECT 'unsupported_literal', 'small-' || k FROM th WHERE NOT small")
def theory_problems(s, d):
    return _theory(s, d).problems()


@query("why_not", f"WITH {_TH} SELECT 's3' AS rule, 'failed_body' AS blocker, 'small-3' AS what FROM th WHERE k = 3")
def why_not(s, d):
    t = _theory(s, d)
    return reason.why_not(t, reason.conclusions(t), "~exporter-3")


@query("required_facts", f"WITH {_TH} SELECT 's1' AS rule, 'small-1' AS needed, false AS open FROM th WHERE k = 1 AND NOT small")
def required_facts(s, d):
    t = _theory(s, d)
    return reason.require(t, reason.conclusions(t), "~exporter-1")


@query("proof_sources", f"WITH {_TH} SELECT 'known-' || k AS literal, '+D' AS tag, 'n' || k || '.md' AS path, count(*) AS n FROM th JOIN (VALUES (1), (2)) v(x) ON has GROUP BY 1, 2, 3")
def proof_sources(s, d):
    t = _theory(s, d)
    return reason.proof_sources(t, reason.conclusions(t)).filter("literal like 'known-%'").groupBy("literal", "tag", "path").agg(F.count("*").alias("n"))


@query("what_if", f"WITH {_TH} SELECT 'exporter-' || k AS literal, 'changed' AS change, CASE WHEN has THEN '+d' ELSE '-D' END AS was, CASE WHEN has THEN '-D' ELSE '-D' END AS now FROM th WHERE has AND NOT pref AND NOT small")
def what_if(s, d):
    t = _theory(s, d)
    before = reason.conclusions(t)
    more = s.range(25).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("label"), F.concat(F.lit("small-"), F.col("id").cast("string")).alias("literal"), F.lit("x.md").alias("path"), F.lit(1).alias("line"), F.lit("x").alias("page"))
    t.facts = t.facts.unionByName(more)
    return reason.what_if(before, reason.conclusions(t)).filter("literal like 'exporter-%'")


@query("edge_facts", f"""WITH {model.GRAPH} SELECT '(' || predicate || ' "' || source || '" "' || target || '")' AS literal, (SELECT min(path) FROM pages_ WHERE page = source) AS path, line FROM edges_ WHERE predicate IS NOT NULL""")
def edge_facts_(s, d):
    return edge_facts(model.edges(s, d), model.pages(s, d)).select("literal", "path", "line")


# streams, run as batches or to their end


@query("rate_limit")
def rate_limit(s, d):
    e = read(s, d, "events").select(S("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return watch.rate_limit(e.select("key", (F.col("t") / 1e6).alias("t")), 86400.0, 5)


@query("hits_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def hits_in_window(s, d):
    e = read(s, d, "events").select("event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return watch.hits_within(e, 86400000000).select("event_id", "n")


@query("log_replay", "SELECT CAST(user_id AS VARCHAR) AS slug, arg_max(event_type, event_id) AS content, max(event_id) AS seq FROM events e WHERE event_type <> 'error' AND event_id > coalesce((SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error'), -1) GROUP BY 1")
def log_replay(s, d):
    return watch.replay(read(s, d, "events").select(S("user_id").alias("slug"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("truncate")))


@query("snapshot_append", "SELECT 'new' AS vault_root_hash")
def snapshot_append(s, d):
    e = read(s, d, "events").select("ts", F.col("event_type").alias("vault_root_hash"))
    last = e.orderBy(F.desc("ts")).limit(1)
    return watch.append_snapshot(e, last.unionByName(last.withColumn("vault_root_hash", F.lit("new")))).select("vault_root_hash")


@query("literal_suggestions")
def literal_suggestions(s, d):
    return search.nearest_literals(_theory(s, d).rules.select(F.col("head").alias("literal")).distinct(), "exporter-3")
