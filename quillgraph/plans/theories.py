"""Queries of reasoning over a theory with a page for each customer, and of a vault of orders that is watched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..logic import parts, reason
from ..logic.rules import Theory
from ..operators import search
from ..operators.vectors import VectorIndex
from ..scratch import table
from ..streaming.vault_watch import VaultWatch
from .more import _place
from .registry import query
from .tables import S, read


def _customers(s, d):
    """(k, active, debt, pref): who has urgent orders, who owes, and whose orders count for more."""
    active = read(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit(True).alias("active")).distinct()
    c = read(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") < 0).alias("debt"), (F.col("c_mktsegment") == "BUILDING").alias("pref"))
    return c.join(active, "k", "left").na.fill(False, ["active"])


def _theory(s, d, customers=None):
    """Six rules a customer, one of them strict and one a defeater, with a chain of three, and up to two facts and a preference."""
    rules = "(normally g# active-# good-#)\n(normally b# debt-# (not good-#))\n(normally r# good-# trusted-#)\n(except x# debt-# (not trusted-#))\n(normally v# (and trusted-# known-#) vip-#)\n(always k# active-# known-#)"
    said = lambda test, text: F.when(test, F.lit(text))
    content = F.replace(F.concat_ws("\n", F.lit(rules), said(F.col("pref"), "(prefer g# b#)"), said(F.col("active"), "(given active-#)"), said(F.col("debt"), "(given debt-#)")), F.lit("#"), S("k"))
    blocks = (_customers(s, d) if customers is None else customers).select(F.concat(F.lit("c"), S("k"), F.lit(".spl")).alias("path"), F.concat(F.lit("c"), S("k")).alias("page"), F.lit(0).alias("ord"), F.lit(1).alias("start_line"), content.alias("content"))
    return Theory.of_blocks(blocks)


_CUST = "cust AS (SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS active, c_acctbal < 0 AS debt, c_mktsegment = 'BUILDING' AS pref FROM customer)"


def _tags(cust: str = "cust") -> str:
    """lits(k, literal, s, h): what is proven strictly and what holds; tags(literal, tag)."""
    held = (("active-", "active", "active"), ("debt-", "debt", "debt"), ("known-", "active", "active"), ("good-", "false", "active AND (NOT debt OR pref)"), ("~good-", "false", "debt AND NOT active"), ("trusted-", "false", "active AND NOT debt"), ("vip-", "false", "active AND NOT debt"))
    never = ("~active-", "~debt-", "~known-", "~trusted-", "~vip-")
    lits = " UNION ALL ".join([*(f"SELECT k, '{n}' || k AS literal, {s} AS s, {h} AS h FROM {cust}" for n, s, h in held), *(f"SELECT k, '{n}' || k, false, false FROM {cust}" for n in never)])
    return f"lits AS ({lits}), tags AS (SELECT literal, CASE WHEN s THEN '+D' ELSE '-D' END AS tag FROM lits UNION ALL SELECT literal, CASE WHEN h THEN '+d' ELSE '-d' END FROM lits)"


@query("customer_conclusions", f"WITH {_CUST}, {_tags()} SELECT * FROM tags")
def customer_conclusions(s, d):
    return reason.conclusions(_theory(s, d))


@query("rounds_of_conclusions", f"WITH {_CUST}, {_tags()} SELECT * FROM tags")
def rounds_of_conclusions(s, d):
    """The same by rounds over tables, as for parts that no task should hold."""
    return parts.by_rounds(parts.statements(_theory(s, d)))[0]


_LATER = "later AS (SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_acctbal < 9000 AS active, c_acctbal < 100 AS debt, c_mktsegment = 'BUILDING' AS pref FROM customer)"


@query("revised_conclusions", f"WITH {_LATER}, {_tags('later')} SELECT * FROM tags")
def revised_conclusions(s, d):
    """Facts that go and come: only the parts of their customers are solved again."""
    before = _theory(s, d)
    bal = read(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    later = _customers(s, d).join(bal, "k").select("k", (F.col("active") & (F.col("c_acctbal") < 9000)).alias("active"), (F.col("c_acctbal") < 100).alias("debt"), "pref")
    return reason.revised(before, reason.conclusions(before), _theory(s, d, later))


_RULES = """rules_ AS (SELECT k, 'g' || k AS label, 1 AS line, 'Defeasible' AS kind, 'good-' || k AS head, ['active-' || k] AS body FROM cust UNION ALL SELECT k, 'b' || k, 2, 'Defeasible', '~good-' || k, ['debt-' || k] FROM cust
    UNION ALL SELECT k, 'r' || k, 3, 'Defeasible', 'trusted-' || k, ['good-' || k] FROM cust UNION ALL SELECT k, 'x' || k, 4, 'Defeater', '~trusted-' || k, ['debt-' || k] FROM cust
    UNION ALL SELECT k, 'v' || k, 5, 'Defeasible', 'vip-' || k, ['trusted-' || k, 'known-' || k] FROM cust UNION ALL SELECT k, 'k' || k, 6, 'Strict', 'known-' || k, ['active-' || k] FROM cust)"""
#: Customers whose vip status fails because a defeater blocks it, and because nothing is given.
_ASKED = "asked AS (SELECT min(k) FILTER (active AND debt AND pref) AS a, min(k) FILTER (NOT active AND NOT debt) AS b FROM cust)"


def _asked(s, d):
    return _customers(s, d).agg(F.min(F.when(F.col("active") & F.col("debt") & F.col("pref"), F.col("k"))).alias("a"), F.min(F.when(~F.col("active") & ~F.col("debt"), F.col("k"))).alias("b")).first()


@query("defeat_chains", f"""WITH RECURSIVE {_CUST}, {_tags()}, {_RULES}, {_ASKED}, good_ AS (SELECT DISTINCT literal FROM tags WHERE tag IN ('+D', '+d')),
    parts_ AS (SELECT label, head, kind, k, unnest(body) AS x, generate_subscripts(body, 1) AS i FROM rules_),
    told AS (SELECT p.label, any_value(p.head) AS head, any_value(p.kind) AS kind, any_value(k) AS k, string_agg(x, ',' ORDER BY i) AS body, coalesce(string_agg(x, ',' ORDER BY i) FILTER (g.literal IS NULL), '') AS lacking FROM parts_ p LEFT JOIN good_ g ON g.literal = x GROUP BY p.label),
    walk(literal, depth) AS (SELECT 'vip-' || unnest([a, b]), 0 FROM asked UNION SELECT unnest(string_split(t.lacking, ',')), depth + 1 FROM walk w JOIN told t ON t.head = w.literal AND t.kind <> 'Defeater' AND t.lacking <> ''),
    front AS (SELECT literal, min(depth) AS depth FROM walk WHERE literal IS NOT NULL GROUP BY literal),
    sides AS (SELECT head AS q, 'for' AS role, * FROM told WHERE kind <> 'Defeater' UNION ALL SELECT CASE WHEN starts_with(head, '~') THEN head[2:] ELSE '~' || head END, 'against', * FROM told)
    SELECT depth, f.literal, (SELECT max(tag) FROM tags t WHERE t.literal = f.literal) AS tag, label AS rule, role, lower(kind) AS kind, body, lacking, 'c' || k || '.spl' AS path FROM front f LEFT JOIN sides ON q = f.literal""")
def defeat_chains(s, d):
    """Why two customers are no vip, down to what isn't given; attackers of all kinds are told."""
    t, asked = _theory(s, d), _asked(s, d)
    found = reason.conclusions(t)
    out = None
    for k in (asked["a"], asked["b"]):
        if k is not None:
            told = reason.explain_failure(t, found, f"vip-{k}")
            out = told if out is None else out.unionByName(told)
    return out.select("depth", "literal", "tag", "rule", "role", "kind", F.array_join("body", ",").alias("body"), F.array_join("lacking", ",").alias("lacking"), "path")


@query("required_chain", f"WITH {_CUST}, {_ASKED} SELECT 'v' || b AS rule, 'active-' || b AS needed, false AS open FROM asked WHERE b IS NOT NULL")
def required_chain(s, d):
    """What would make a customer a vip: through two rules each, the same fact."""
    t = _theory(s, d)
    return reason.require(t, reason.conclusions(t), f"vip-{_asked(s, d)['b']}")


_LINES = "facts_ AS (SELECT k, 'active-' || k AS literal, 7 + pref::INT AS line FROM cust WHERE active UNION ALL SELECT k, 'debt-' || k, 7 + pref::INT + active::INT FROM cust WHERE debt)"


@query("theory_json", f"""WITH {_CUST}, {_tags()}, {_RULES}, {_LINES},
    fired AS (SELECT * FROM rules_ WHERE kind <> 'Defeater' AND label NOT IN (SELECT label FROM (SELECT label, unnest(body) AS x FROM rules_) WHERE x NOT IN (SELECT literal FROM lits WHERE s OR h))),
    proofs AS (SELECT DISTINCT literal, k, line FROM (SELECT f.head AS literal, f.k, f.line FROM fired f UNION ALL SELECT literal, k, line FROM facts_ UNION ALL SELECT f.head, f.k, x.line FROM fired f JOIN facts_ x ON list_contains(f.body, x.literal)) JOIN lits USING (literal, k) WHERE s OR h),
    told AS (SELECT literal, string_agg('{{"page":"c' || k || '","path":"c' || k || '.spl","line":' || line || '}}', ',' ORDER BY line) AS p FROM proofs GROUP BY literal)
    SELECT 'facts' AS part, '{{"literal":"' || literal || '","source_file":"c' || k || '.spl","source_line":' || line || ',"source_page":"c' || k || '"}}' AS value FROM facts_
    UNION ALL SELECT 'rules', '{{"label":"' || label || '","rule_type":"' || kind || '","body":["' || array_to_string(body, '","') || '"],"head":"' || head || '","source_file":"c' || k || '.spl","source_line":' || line || ',"source_page":"c' || k || '"}}' FROM rules_
    UNION ALL SELECT 'superiority', '{{"superior":"g' || k || '","inferior":"b' || k || '"}}' FROM cust WHERE pref
    UNION ALL SELECT 'summary', '{{"fact_count":' || (SELECT count(*) FROM facts_) || ',"rule_count":' || 5 * count(*) || ',"defeater_count":' || count(*) || ',"superiority_count":' || count(*) FILTER (pref) || ',"source_file_count":' || count(*) || '}}' FROM cust
    UNION ALL SELECT 'conclusions', '{{"literal":"' || t.literal || '","conclusion_type":"' || tag || '","proof_sources":[' || CASE WHEN starts_with(tag, '+') THEN coalesce(p, '') ELSE '' END || ']}}' FROM tags t LEFT JOIN told USING (literal)""")
def theory_json(s, d):
    t = _theory(s, d)
    return reason.export_json(t, reason.conclusions(t))


@query("watched_orders", """WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0), o AS (SELECT 'o' || o_orderkey AS page, 'c' || o_custkey AS c, o_custkey AS k, o_orderstatus = 'P' AS p FROM orders)
    SELECT 0 AS epoch, 'page_added' AS event, page, NULL AS target FROM o UNION ALL SELECT 0, 'page_added', 'c' || c_custkey, NULL FROM customer UNION ALL SELECT 0, 'link_added', page, c FROM o
    UNION ALL SELECT 0, 'orphan_gained', page, NULL FROM o UNION ALL SELECT 0, 'orphan_gained', 'c' || c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)
    UNION ALL SELECT 1, 'page_removed', 'c' || k, NULL FROM gone UNION ALL SELECT 1, 'orphan_resolved', 'c' || k, NULL FROM gone WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 1, 'dead_gained', page, c FROM o WHERE k IN (SELECT k FROM gone)
    UNION ALL SELECT 1, unnest(['link_added', 'dead_gained']), page, 'urgent list' FROM o WHERE p UNION ALL SELECT unnest([0, 1]), 'index_updated', NULL, NULL""")
def watched_orders(s, d):
    """A vault of orders and customers; then customers who owe go, and open orders name a page that isn't there."""
    at = _place(s, "order-events")
    c = read(s, d, "customer").select(F.concat(F.lit("c"), S("c_custkey"), F.lit(".md")).alias("path"), F.lit(1).alias("seq"), F.lit("A customer.").alias("content"), (F.col("c_acctbal") < 0).alias("moves"))
    o = read(s, d, "orders").select(F.concat(F.lit("o"), S("o_orderkey"), F.lit(".md")).alias("path"), F.lit(1).alias("seq"), F.concat(F.lit("By [[c"), S("o_custkey"), F.lit("]].")).alias("content"), (F.col("o_orderstatus") == "P").alias("moves"))
    w = VaultWatch(s, lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/n={epoch}"), _place(s, "order-watch"), 16)
    w.batch(c.unionByName(o).drop("moves"), 0)
    again = c.filter("moves").withColumn("content", F.lit(None).cast("string")).unionByName(o.filter("moves").withColumn("content", F.concat("content", F.lit(" See [[urgent list]]."))))
    w.batch(again.drop("moves"), 1)
    return s.read.parquet(at).select("epoch", "event", "page", "target")


@query("sign_neighbours", """WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
    near AS (SELECT q.vec_id AS question, x.vec_id AS id, CAST(len(list_filter(list_zip(q.b, x.b), lambda p: p[1] <> p[2])) AS INTEGER) AS distance FROM f q, f x WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY distance, id) AS INTEGER) AS rank FROM near WHERE distance <= 16) SELECT question, rank, id, distance FROM ranked WHERE rank <= 10""")
def sign_neighbours(s, d):
    """The signs of a vector as a fingerprint: for each question the ten nearest of all vectors, up to 16 bits away."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, y) -> a | y)")
    prints = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("fingerprint"))
    return search.similar_all(prints, prints.filter("id % 20 = 0").select(F.col("id").alias("question"), "fingerprint"), 16, 10)


@query("similar_documents")
def similar_documents(s, d):
    """Every twentieth document's similar ones by the fingerprints of texts; tests compare with all pairs."""
    prints = table(search.fingerprints(read(s, d, "documents"), "doc_id").filter("id is not null"), "prints")
    return search.similar_all(prints, prints.filter("id % 20 = 0").select(F.col("id").alias("question"), "fingerprint"))


_DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query("nearest_vectors", f"""WITH scored AS (SELECT q.vec_id AS question, e.vec_id AS id, {_DOT} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 5) AS score FROM scored) SELECT * FROM ranked WHERE rank <= 10""")
def nearest_vectors(s, d):
    """For each question the ten nearest of all vectors, by an index of cells."""
    e = read(s, d, "embeddings")
    index = VectorIndex.build(e, _place(s, "cells"), cells=64)
    return index.nearest(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))).withColumn("score", F.round("score", 5))
