"""Typed links as RDF: triples and three ways to write them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import display_label
from ..scratch import table
from .lint import Vocabulary

#: Name spaces of public vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
KNOWN = {"rdf": RDF, "rdfs": RDFS, "prov": PROV, "dcterms": DCTERMS, "skos": SKOS}


def iri_encode(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and -_.~ over the bytes of the text."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def escape_literal(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, to in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return out


def predicate_iri(predicate: Column, base: str, v: Vocabulary | None) -> Column:
    """A prefixed name, or what the vocabulary maps a name to, in its declared name space; all else in the vault's own."""
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else None
    own = F.concat(F.lit(base + "predicate/"), iri_encode(predicate))
    if not v or not v.prefixes:
        return own
    mapped = F.element_at(pairs(v.maps_to), predicate) if v.maps_to else F.lit(None).cast("string")
    curie = F.when(predicate.contains(":"), predicate).otherwise(mapped)
    space = F.element_at(pairs(v.prefixes), F.split(curie, ":")[0])
    return F.coalesce(F.concat(space, F.regexp_replace(curie, "^[^:]*:", "")), own)


def _pathed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a range of pages and links by source, pages first: `k` counts them, `path` is that of their source's page.

    `open` tells that the source's first row lies in a range before. A last row has the last source, the path known of it
    and, as k, how many links there were.
    """
    names = ["source", "target", "predicate", "annotation", "line", "path"]
    src, at, opened, n, now = None, None, True, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        source, path, link = b.column("source"), b.column("path"), b.column("link").to_numpy(zero_copy_only=False)
        before = pa.concat_arrays([pa.array([src], source.type), source[:-1]])
        same = pc.or_(pc.fill_null(pc.equal(source, before), False), pc.and_(source.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
        first = now is None
        if first:
            same[0] = False
        start = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        paths = pc.take(pa.concat_arrays([pa.array([at], path.type), path]), pa.array(start + 1))
        opens = (start == -1) & opened | (start == 0) & (first and link[0])
        k = n + np.cumsum(link) - 1
        now = b.schema
        src, at, opened, n = source[-1].as_py(), paths[-1].as_py(), bool(opens[-1]), n + int(link.sum())
        out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), paths, pa.array(opens), pa.array(k), pa.array(np.zeros(len(same), bool))], names=[*names, "open", "k", "last"])
        yield out.filter(pa.array(link))
    if now is not None:
        some = {"source": src, "path": at, "open": opened, "k": n, "last": True}
        kinds = {"open": pa.bool_(), "k": pa.int64(), "last": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array([some.get(c)], kinds[c] if c in kinds else now.field(c).type) for c in [*names, *kinds]], names=[*names, *kinds])


def _stated(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(i, source, target, predicate, annotation, line, path) of each typed link: its place among all links in order, and its page's least path.

    Pages and links are dealt out by the order of sources together, so a path meets its links where they are numbered
    and links move once.
    """
    own = edges.select("source", F.lit(True).alias("link"), F.lit(None).cast("string").alias("path"), "target", "predicate", "annotation", "line")
    paths = pages.filter("page is not null and path is not null").select(F.col("page").alias("source"), F.lit(False).alias("link"), "path")
    both = own.unionByName(paths, allowMissingColumns=True)
    order = ["source", "link", F.asc_nulls_last("path"), "target", F.asc_nulls_first("predicate"), "line", "annotation"]
    kind = {f.name: f.dataType.simpleString() for f in both.schema}
    cols = ", ".join(f"{c} {kind[c]}" for c in ("source", "target", "predicate", "annotation", "line", "path"))
    ranged = both.repartitionByRange(_places(both), *order).sortWithinPartitions(*order).mapInArrow(_pathed, f"{cols}, open boolean, k long, last boolean")
    kept = table(ranged.filter("last or predicate is not null").withColumn("_p", F.spark_partition_id()), "numbered")
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.filter("last").select("_p", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("_off"), F.last(F.when(~F.col("open"), F.struct("source", "path")), ignorenulls=True).over(upto).alias("_had"))
    path = F.when(~F.col("open"), F.col("path")).when(F.col("source") == F.col("_had.source"), F.col("_had.path"))
    return kept.filter("not last").join(F.broadcast(ends), "_p").select((F.col("k") + F.col("_off")).alias("i"), "source", "target", "predicate", "annotation", "line", path.alias("path"))


#: Rows that a task sorts, so that they fit into its memory.
SORTED = 1_500_000


def _places(rows: DataFrame, times: int = 1) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-times * rows.count() // SORTED))


def _words(stated: DataFrame, base: str, vocabulary: Vocabulary | None) -> DataFrame:
    """(s, p, o, o_kind) of the vocabulary, distinct but where two predicates have one IRI."""
    p = predicate_iri(F.col("predicate"), base, vocabulary)
    labels = {k: x for k, x in (vocabulary.labels if vocabulary else {}).items() if x}
    t = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    scheme = F.lit(base + "vocabulary")
    words = stated.select("predicate").distinct().select(F.explode(F.array(t(p, RDF + "type", F.lit(SKOS + "Concept"), "iri"), t(p, SKOS + "inScheme", scheme, "iri"), t(p, SKOS + "prefLabel", display_label(F.col("predicate"), labels), "literal"))).alias("t")).select("t.*")
    top = stated.sparkSession.range(1).select(t(scheme, RDF + "type", F.lit(SKOS + "ConceptScheme"), "iri").alias("t")).select("t.*")
    return words.unionByName(top)


def _link(base: str, vocabulary: Vocabulary | None) -> list[Column]:
    return [_page("source", base).alias("s"), predicate_iri(F.col("predicate"), base, vocabulary).alias("p"), _page("target", base).alias("o"), F.lit("iri").alias("o_kind")]


def _subject(base: str) -> Column:
    return F.concat(F.lit(base + "statement/"), F.col("i").cast("string"))


def _page(c: str, base: str) -> Column:
    return F.concat(F.lit(base + "page/"), iri_encode(F.col(c)))


def _about(base: str, vocabulary: Vocabulary | None) -> list[tuple[str, str, Column]]:
    """(p, o_kind, o) of what is said of a statement, in order; an o may be null, then nothing is."""
    own = _page("source", base)
    return [
        (DCTERMS + "source", "literal", F.when(F.col("path").isNotNull(), F.concat_ws(":", "path", F.col("line").cast("string")))), (RDF + "object", "iri", _page("target", base)),
        (RDF + "predicate", "iri", predicate_iri(F.col("predicate"), base, vocabulary)), (RDF + "subject", "iri", own), (RDF + "type", "iri", F.lit(RDF + "Statement")),
        (RDFS + "comment", "literal", F.col("annotation")), (PROV + "wasAttributedTo", "iri", own),
    ]


def _told(stated: DataFrame, base: str, vocabulary: Vocabulary | None) -> DataFrame:
    """(s, about): what is said of each statement, as an array of (p, o_kind, o) in order."""
    said = _about(base, vocabulary)
    made = stated.select("s", *(o.alias(f"_{i}") for i, (_, _, o) in enumerate(said)))
    about = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), F.col(f"_{i}").alias("o")) for i, (p, kind, _) in enumerate(said)))
    return made.select("s", F.filter(about, lambda x: x["o"].isNotNull()).alias("about"))


def triples(edges: DataFrame, pages: DataFrame, base: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(s, p, o, o_kind), distinct: each typed edge, the statement about it, and the vocabulary as a concept scheme.

    Statements are numbered by the place of their edge among all edges in order, untyped ones included. A statement's
    subject is its own, so only the links themselves and the vocabulary are compared with each other.
    """
    stated = _stated(edges, pages)
    rest = stated.filter("target is not null").select(*_link(base, vocabulary)).unionByName(_words(stated, base, vocabulary)).distinct()
    return _told(stated.withColumn("s", _subject(base)), base, vocabulary).select("s", F.explode("about").alias("t")).select("s", "t.p", "t.o", "t.o_kind").unionByName(rest)


def written(edges: DataFrame, pages: DataFrame, base: str, vocabulary: Vocabulary | None, form: str) -> DataFrame:
    """What ntriples(), turtle() or jsonld() give for triples(), in order, without sorting the triples of statements.

    A statement is one row until its place in the order is known, and its triples are written there. Links get there by
    the same move, and equal ones are found where they meet.
    """
    stated, keys, fields = _stated(edges, pages), ["s", "p", "o_kind", "o"], ["source", "target", "predicate", "annotation", "line", "path"]
    none = F.lit(None).cast("string")
    told = F.struct(_subject(base).alias("s"), none.alias("p"), none.alias("o"), none.alias("o_kind"), F.struct(*fields).alias("told"))
    link = F.when(F.col("target").isNotNull(), F.struct(*_link(base, vocabulary), F.lit(None).cast(stated.select(F.struct(*fields).alias("told")).schema["told"].dataType).alias("told")))
    rows = stated.select(F.inline(F.array(told, link))).filter("told is not null or p is not null").unionByName(_words(stated, base, vocabulary), allowMissingColumns=True)
    # ranges of an order hold equal keys together, so groups and the order need no other move
    one = rows.repartitionByRange(_places(stated, 2), *(keys if form == "ntriples" else keys[:1])).groupBy(*keys).agg(F.first("told").alias("told"))
    # what is said of a statement is written by its form: each p has its place there
    said = _about(base, vocabulary)
    objects = [o.alias(f"_{i}") for i, (_, _, o) in enumerate(said)]
    each = [(p, kind, F.col(f"_{i}")) for i, (p, kind, _) in enumerate(said)]
    if form == "ntriples":
        made = one.orderBy(*keys).select(*keys, "told.*").select(*keys, *objects)
        lines = F.array(*(_line("s", F.lit(p), kind, o) for p, kind, o in each))
        return made.select(F.explode(F.when(F.col("p").isNull(), lines).otherwise(F.array(_own_line()))).alias("value")).filter("value is not null")
    has = one.groupBy("s").agg(F.first("told", ignorenulls=True).alias("told"), F.collect_list(F.when(F.col("told").isNull(), F.struct(*keys[1:]))).alias("has")).orderBy("s")
    made = has.select("s", "has", F.col("told").isNotNull().alias("is_told"), "told.*").select("s", "has", "is_told", *objects)
    if form == "turtle":
        own, pairs, ends = _turtle(F.col("s"), F.col("has"), KNOWN), {f"{_short(p)} ": _object(kind, o, KNOWN) for p, kind, o in each}, (F.concat(_name(F.col("s"), KNOWN), F.lit(" ")), " ;\n    ", " .")
    else:
        own, pairs, ends = _jsonld(F.col("s"), F.col("has")), {f'"{p}":[': F.concat(_value(kind, o), F.lit("]")) for p, kind, o in each}, (F.concat(F.lit('{"@id":"'), escape_literal(F.col("s")), F.lit('",')), ",", "}")
    whole = F.concat(ends[0], F.array_join(F.array(*(F.concat(F.lit(k), pairs[k]) for k in sorted(pairs))), ends[1]), F.lit(ends[2]))
    return made.select(F.when(F.col("is_told"), whole).otherwise(own).alias("value"))


def _line(s: str, p: Column, kind: str, o: Column) -> Column:
    """Null if o is; a link without a source has no subject."""
    a, b = (F.lit("> <"), F.lit("> .")) if kind == "iri" else (F.lit('> "'), F.lit('" .'))
    return F.concat(F.coalesce(F.concat(F.lit("<"), F.col(s), F.lit("> ")), F.lit("")), F.lit("<"), p, a, o if kind == "iri" else escape_literal(o), b)


def _own_line() -> Column:
    return F.when(F.col("o_kind") == "iri", _line("s", F.col("p"), "iri", F.col("o"))).otherwise(_line("s", F.col("p"), "literal", F.col("o")))


def ntriples(found: DataFrame) -> DataFrame:
    """One line a triple, in order."""
    return found.orderBy("s", "p", "o_kind", "o").select(_own_line().alias("value"))


def _name(c: Column, known: dict[str, str]) -> Column:
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for k, ns in known.items():
        local = F.substring(c, F.lit(len(ns) + 1), F.length(c))
        out = F.when(c.startswith(ns) & local.rlike(LOCAL), F.concat(F.lit(k + ":"), local)).otherwise(out)
    return out


#: What may stand after a prefix.
LOCAL = r"^[A-Za-z][A-Za-z0-9_]*$"


def _short(iri: str) -> str:
    """_name() of one of our own IRIs."""
    return next((f"{k}:{iri[len(ns) :]}" for k, ns in reversed(KNOWN.items()) if iri.startswith(ns) and re.fullmatch(LOCAL, iri[len(ns) :])), f"<{iri}>")


def _object(kind: str, o: Column, known: dict[str, str]) -> Column:
    return _name(o, known) if kind == "iri" else F.concat(F.lit('"'), escape_literal(o), F.lit('"'))


def _turtle(s: Column, has: Column, known: dict[str, str]) -> Column:
    def pair(x: Column) -> Column:
        o = F.when(x["o_kind"] == "iri", _object("iri", x["o"], known)).otherwise(_object("literal", x["o"], known))
        return F.concat_ws(" ", _name(x["p"], known), o)

    return F.concat(_name(s, known), F.lit(" "), F.array_join(F.sort_array(F.transform(has, pair)), " ;\n    "), F.lit(" ."))


def turtle(found: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One block a subject."""
    by = found.groupBy("s").agg(F.collect_list(F.struct("p", "o_kind", "o")).alias("has"))
    return by.orderBy("s").select(_turtle(F.col("s"), F.col("has"), KNOWN | (prefixes or {})).alias("value"))


def _value(kind: str, o: Column) -> Column:
    """Null if o is."""
    return F.when(o.isNotNull(), F.to_json(F.struct(o.alias("@id" if kind == "iri" else "@value"))))


def _jsonld(s: Column, has: Column) -> Column:
    value = lambda x: F.when(x["o_kind"] == "iri", _value("iri", x["o"])).otherwise(_value("literal", x["o"]))
    pairs = F.transform(has, lambda x: F.struct(x["p"].alias("p"), value(x).alias("v")))
    own = lambda p: F.concat(F.lit('"'), escape_literal(p), F.lit('":['), F.array_join(F.sort_array(F.transform(F.filter(pairs, lambda x: x["p"] == p), lambda x: x["v"])), ","), F.lit("]"))
    kvs = F.sort_array(F.transform(F.array_distinct(F.transform(has, lambda x: x["p"])), own))
    return F.concat(F.lit('{"@id":"'), escape_literal(s), F.lit('",'), F.array_join(kvs, ","), F.lit("}"))


def jsonld(found: DataFrame) -> DataFrame:
    """One node object a subject."""
    by = found.groupBy("s").agg(F.collect_list(F.struct("p", "o_kind", "o")).alias("has"))
    return by.orderBy("s").select(_jsonld(F.col("s"), F.col("has")).alias("value"))
