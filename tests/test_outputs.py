"""Outputs without SQL: triples read back from their notations, and similar texts against all pairs."""

import json
import re

from quillgraph import plans
from quillgraph.functions.hashes import fingerprint_of
from quillgraph.operators import rdf, search

D = "/root/testdata/sf0.001"
ODD = [("http://a/b", "http://p/q", "say \"no\"\\n\n\tend\r", "literal"), ("http://a/b", "http://p/q", "http://a/c", "iri"), ("http://a/b", "http://p/r", "été", "literal"), ("http://a/c", "http://p/q", "", "literal"), ("http://a/c", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2004/02/skos/core#Concept", "iri")]
PREFIXES = {"rdf": rdf.RDF, "rdfs": rdf.RDFS, "prov": rdf.PROV, "dcterms": rdf.DCTERMS, "skos": rdf.SKOS}
NAME = r"(?:<([^>]*)>|([a-z]+):([A-Za-z][A-Za-z0-9_]*))"


def iri(m, at):
    return m[at] if m[at] is not None else PREFIXES[m[at + 1]] + m[at + 2]


def unescaped(text):
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), text)


def of_turtle(block):
    m = re.match(NAME + " ", block)
    s, at = iri(m, 1), m.end()
    while True:
        m = re.compile(NAME + " (?:" + NAME + r'|"((?:[^"\\]|\\.)*)")').match(block, at)
        yield (s, iri(m, 1), unescaped(m[7]), "literal") if m[7] is not None else (s, iri(m, 1), iri(m, 4), "iri")
        at = m.end()
        if block[at:] == " .":
            return
        assert block.startswith(" ;\n    ", at)
        at += len(" ;\n    ")


def of_json(node):
    told = json.loads(node)
    for p, values in told.items():
        if p != "@id":
            for v in values:
                yield (told["@id"], p, v["@id"], "iri") if "@id" in v else (told["@id"], p, v["@value"], "literal")


def test_notations_read_back(spark):
    for found in (spark.createDataFrame(ODD, "s string, p string, o string, o_kind string"), plans.QUERIES["rdf_triples"](spark, D)):
        want = {tuple(r[c] for c in ("s", "p", "o", "o_kind")) for r in found.collect()}
        for write, read in ((rdf.turtle, of_turtle), (rdf.jsonld, of_json)):
            got = [t for r in write(found).collect() for t in read(r.value)]
            assert len(got) == len(set(got)) and set(got) == want


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def print_of(text):
    """The fingerprint feature by feature."""
    out = set()
    for word in "".join(c if c.isalnum() else " " if c.isspace() or c in "-_" else "" for c in (text or "").lower()).split():
        features = [("w:" + word, 3), *([("s:" + word[:4], 2)] if len(word.encode()) >= 4 else []), *(("t:" + word[i : i + 3], 1) for i in range(len(word) - 2))]
        out |= {fnv(f) >> 8 * i & 63 for f, n in features for i in range(n)}
    return sum(1 << b for b in out)


def nearest(rows, text, threshold, limit):
    want = print_of(text)
    away = sorted((bin(print_of(t) ^ want).count("1"), i) for i, t in rows)
    return [(i, d) for d, i in away if d <= threshold][:limit]


def test_similar_texts(spark):
    parts = [(str(r.p_partkey), r.p_name) for r in spark.read.parquet(f"{D}/part.parquet").collect()]
    assert [(r.id, r.distance) for r in plans.QUERIES["similar_texts"](spark, D).collect()] == nearest(parts, "small widget", 20, 10)
    heads = [(f"{no}{kind}-{k}",) * 2 for k in range(25) for no, kind in (("", "exporter"), ("~", "exporter"), ("", "known"))]
    assert [(r.id, r.distance) for r in plans.QUERIES["literal_suggestions"](spark, D).collect()] == nearest(heads, "exporter-3", 16, 5)
    assert all(fingerprint_of(t) % 2**64 == print_of(t) for t in ("Größe_x-y 12", "", None, "a b c abc abcd"))


def test_similar_documents(spark):
    docs = [(r.doc_id, print_of(r.text)) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = set()
    for q, f in docs:
        if q % 20 == 0:
            near = sorted((bin(f ^ g).count("1"), i) for i, g in docs)
            want |= {(q, n, i, d) for n, (d, i) in enumerate([x for x in near if x[0] <= 12][:10], 1)}
    assert {tuple(r) for r in plans.QUERIES["similar_documents"](spark, D).collect()} == want
    short = spark.createDataFrame([(i, f"page about topic {i % 7}") for i in range(40)], "page long, text string")
    prints = search.fingerprints(short)
    rows = search.similar_all(prints, prints.selectExpr("id as question", "fingerprint"), 10, 6).collect()
    assert len(rows) == 240 and all(r.distance == 0 for r in rows if r["rank"] <= 5)
