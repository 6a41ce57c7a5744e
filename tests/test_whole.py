"""Registered queries leave nothing out: small tables with large keys against brute force."""

import hashlib
from collections import defaultdict

import pytest

from quillgraph import plans
from quillgraph.operators import find, search

N = 30


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders, customers and parts with keys below and above 2000; each order has one to five lines."""
    d = str(tmp_path_factory.mktemp("tables"))
    key = lambda i: i if i % 2 else 2000 + i
    rows = {
        "region": ("r_regionkey long", [(i,) for i in range(2)]),
        "nation": ("n_nationkey long, n_regionkey long", [(i, i % 2) for i in range(4)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long", [(key(i), f"Customer {key(i)}", i % 4) for i in range(8)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(i, i % 4) for i in range(6)]),
        "part": ("p_partkey long, p_size int", [(key(i), 10 + 3 * i) for i in range(12)]),
        "orders": ("o_orderkey long, o_custkey long", [(key(i), key(i % 7)) for i in range(N)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string", [(key(i), k, key((5 * i + 3 * k) % 12), (i + k) % 6, "RAN"[k % 3]) for i in range(N) for k in range(1, 2 + i % 5)]),
    }
    for name, (schema, some) in rows.items():
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d, {name: some for name, (_, some) in rows.items()}


def sha(text) -> str:
    return hashlib.sha256(str(text).encode()).hexdigest()


def leaves(t):
    """path: (type, level, hash, block id) by position."""
    out = defaultdict(list)
    for order, line, part, _, _ in sorted(t["lineitem"]):
        kind = {1: "heading", 3: "rules"}.get(line % 4, "paragraph")
        out[str(order)].append((kind, 1 + part % 3 if kind == "heading" else None, sha(part), f"b{part}" if part % 5 == 0 else None))
    return out


def sections_of(blocks):
    """(first, last, own heading's position or None) of each section, by number."""
    heads = [i for i, b in enumerate(blocks) if b[0] == "heading"]
    out = {}
    if not heads or heads[0] > 0:
        out[0] = (0, (heads[0] if heads else len(blocks)) - 1, None)
    for k, h in enumerate(heads, 1):
        out[k] = (h, next((j for j in heads if j > h and blocks[j][1] <= blocks[h][1]), len(blocks)) - 1, h)
    return out


def ground(t):
    """(path, position, hash of the block, hash of the section around it)."""
    out = []
    for path, blocks in leaves(t).items():
        for i, b in enumerate(blocks):
            if b[0] == "rules":
                own = max((j for j in range(i) if blocks[j][0] == "heading"), default=None)
                first, last = next((f, l) for f, l, h in sections_of(blocks).values() if h == own)
                inside = [x[2] for x in blocks[first : last + 1] if x[0] != "rules"]
                out.append((path, i, b[2], sha("\n".join(inside)) if inside else None))
    return out


def test_hashes_of_all_files(spark, tables):
    d, t = tables
    roots = {p: sha("\n".join(b[2] for b in blocks)) for p, blocks in leaves(t).items()}
    assert dict(map(tuple, plans.QUERIES["file_roots"](spark, d).collect())) == roots
    parts = [sha(f"{p}\n{h}") for p, h in roots.items()]
    whole = [str(sum(int(x[8 * i : 8 * i + 8], 16) for x in parts)) for i in range(8)]
    assert [tuple(r) for r in plans.QUERIES["vault_root"](spark, d).collect()] == [(N, sha(",".join([str(N), *whole])))]


def test_sections_and_groundings_of_all_files(spark, tables):
    d, t = tables
    want = {(p, k, f, l) for p, blocks in leaves(t).items() for k, (f, l, _) in sections_of(blocks).items()}
    assert {tuple(r) for r in plans.QUERIES["sections"](spark, d).collect()} == want
    assert {tuple(r) for r in plans.QUERIES["groundings"](spark, d).collect()} == set(ground(t))
    changed = {(p, i + 1, h) for p, i, h, g in ground(t) if int(p) % 3 == 1 and g}
    assert {tuple(r) for r in plans.QUERIES["grounding_drift"](spark, d).collect()} == changed


def test_blocks_and_prefixes_of_all_files(spark, tables):
    d, t = tables
    files = leaves(t)
    asked = {(str(o), f"b{c % 20 * 5}") for o, c in t["orders"]}
    want = {(p, b, next((x[2] for x in files[p] if x[3] == b), None)) for p, b in asked}
    assert {tuple(r) for r in plans.QUERIES["block_id_lookup"](spark, d).collect()} == want
    known = {x[2] for blocks in files.values() for x in blocks}
    hits = {sha(p)[:10]: sum(h.startswith(sha(p)[:10]) for h in known) for p, _ in t["part"]}
    got = {(r["prefix"], r["n_hashes"], r["status"]) for r in plans.QUERIES["hash_prefixes"](spark, d).collect()}
    assert got == {(p, n, ("not_found", "found", "ambiguous")[min(n, 2)]) for p, n in hits.items()}


def edges_of(t):
    """(source, target, predicate, annotation, line) of every foreign key, repeats included."""
    paged = {p for p, size in t["part"] if size <= 25}
    out = [(f"nation:{n}", f"region:{r}", "located_in", None, 1) for n, r in t["nation"]]
    out += [(f"customer:{c}", f"nation:{n}", "based_in", None, 1) for c, _, n in t["customer"]]
    out += [(f"supplier:{s}", f"nation:{n}", p, None, k) for s, n in t["supplier"] for p, k in (("based_in", 1), (None, 2))]
    out += [(f"order:{o}", f"customer:{c}", "placed_by", None, 1) for o, c in t["orders"]]
    for o, k, p, s, flag in t["lineitem"]:
        out.append((f"order:{o}", f"part:{p}", "contains", "returned" if flag == "R" else None, k + 1))
        if p in paged:
            out.append((f"part:{p}", f"supplier:{s}", "supplied_by", None, k))
    return out


def within(steps, start, depth):
    """Least depth of each node within depth hops of start."""
    seen = {start: 0}
    for hop in range(1, depth + 1):
        for b in {b for a, b in steps if seen.get(a) == hop - 1} - set(seen):
            seen[b] = hop
    return seen


def rows(spark, d, name):
    return sorted(map(tuple, plans.QUERIES[name](spark, d).collect()), key=repr)


def test_graph_queries_see_all_links(spark, tables):
    d, t = tables
    links = edges_of(t)
    out = {(e[0], e[1]) for e in links}
    both = out | {(b, a) for a, b in out}
    nodes = {x for e in out for x in e}
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in out:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert dict(rows(spark, d, "components")) == {x: find(x) for x in nodes}
    assert dict(rows(spark, d, "neighbourhood")) == within(both, "supplier:3", 3)

    near = within(both, "nation:3", 2)
    assert rows(spark, d, "induced_subgraph") == sorted(((a, b, p, k) for a, b, p, _, k in links if a in near and b in near), key=repr)
    back = within({(b, a) for a, b in out}, "region:1", 1)
    assert rows(spark, d, "backlinks_depth") == sorted({(a, b, k, back[b] + 1) for a, b, _, _, k in links if b in back}, key=repr)
    assert rows(spark, d, "near_filter") == [(x,) for x in sorted(within(both, "nation:3", 1))]  # all of them have pages

    after = defaultdict(set)
    for a, b in out:
        after[a].add(b)
    want = {}
    for a in nodes:
        front = {a}
        for hop in (1, 2, 3):
            front = {c for b in front for c in after[b]}
            for c in front:
                want.setdefault((a, c), hop)
    assert {(a, b): h for a, b, h in rows(spark, d, "closure")} == want


def test_facts_and_triples_of_all_links(spark, tables):
    d, t = tables
    typed = [e for e in edges_of(t) if e[2]]
    paths = {f"{k}:{x[0]}": f"{k}/{x[0]}.md" for k, table in (("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"), ("order", "orders")) for x in t[table]}
    paths |= {f"part:{p}": f"part/{p}.md" for p, size in t["part"] if size <= 25}
    assert rows(spark, d, "edge_facts") == sorted(((f'({p} "{a}" "{b}")', paths[a], k) for a, b, p, _, k in typed), key=repr)

    base, geo = "http://example.org/v/", "http://example.org/geo#within"
    iri = lambda x: f"{base}page/{x.replace(':', '%3A')}"
    name = lambda p: geo if p == "located_in" else f"{base}predicate/{p}"
    found = rows(spark, d, "rdf_triples")
    assert len(found) == len(set(found))
    said = {(s, p, o) for s, p, o, _ in found if s.startswith(f"{base}page/")}
    assert said == {(iri(a), name(p), iri(b)) for a, b, p, _, _ in typed}
    about = defaultdict(dict)
    for s, p, o, _ in found:
        if s.startswith(f"{base}statement/"):
            about[s][p.split("/")[-1].split("#")[-1]] = o
    told = [(x["subject"], x["predicate"], x["object"], x["source"], x.get("comment")) for x in about.values()]
    assert sorted(told, key=repr) == sorted(((iri(a), name(p), iri(b), f"{paths[a]}:{k}", note) for a, b, p, note, k in typed), key=repr)
    for written in ("rdf_ntriples", "rdf_turtle", "rdf_jsonld"):
        assert "/order%3A2000>" in (text := "\n".join(r[0] for r in rows(spark, d, written))) or "/order%3A2000\"" in text


def test_access_is_reasoned_for_all_customers(spark, tables):
    d, t = tables
    found = rows(spark, d, "access_reasoned")
    assert {r[0] for r in found} == {name for _, name, _ in t["customer"]} and len(found) == 6 * len(t["customer"])
    assert found == rows(spark, d, "access_decisions")


def test_search_returns_all_documents(spark):
    docs = spark.range(10_050).selectExpr("id AS page", "'one word' AS text")
    assert search.search(docs, "word").count() == 10_050 and search.search(docs, "word", 7).count() == 7
    pages = docs.selectExpr("cast(page AS string) AS page", "cast(page AS string) AS path", "text AS content")
    heads = spark.createDataFrame([], "path string, line int, text string, level int")
    assert find.full_text(pages, heads, "word", 20_000).count() == 10_050
