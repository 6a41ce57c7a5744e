"""Searches as a user asks for them: text, meaning or both, near a page; pages by an inexact name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import dot
from ..functions.names import path_glob
from . import graph, iterate, search


def context(text: Column, column: Column, length: Column, around: int) -> Column:
    """Up to `around` characters on either side of a place in a line."""
    start = F.greatest(column - around, F.lit(1))
    return F.substring(text, start, column - start + length + around)


def full_text(pages: DataFrame, headings: DataFrame, query: str, limit: int | None = 20, glob: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(page, path, line, column, context, heading, heading_level, score) of pages(page, path, content).

    Pages that hold a term are ranked, and their lines that hold one are the hits: by score, path and line. The limit
    comes before the filter by near(node), so there can be fewer hits than it allows; with None all hits are given.
    """
    if glob:
        pages = pages.filter(path_glob(F.col("path"), glob))
    scored = search.search(pages, query, id_col="path", text_col="content")
    found = pages.join(scored.withColumnRenamed("id", "path"), "path")
    lines = search.line_matches(found, query, "path", "content")
    hits = lines.withColumnRenamed("id", "path").join(found.select("path", "page", "score"), "path").withColumn("offset", F.col("line").cast("long"))
    marked = search.with_headings(hits, headings.select("path", F.col("line").cast("long").alias("offset"), "text", "level"))
    top = marked.select("page", "path", "line", "column", "context", "heading", "heading_level", "score").orderBy(F.desc("score"), "path", "line")
    top = top if limit is None else top.limit(limit)
    return search.near(top, near) if near is not None else top


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, limit: int = 20) -> DataFrame:
    """(page, score): ranks of text_hits(page, score) and vector_hits(page, score) fused, best first."""
    order = [F.desc("score"), F.col("page")]
    fused = search.fuse_ranks(search.ranked_pages(text_hits, order), search.ranked_pages(vector_hits, order))
    return fused.orderBy(*order).limit(limit)


def by_vector(chunks: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(page, heading, score): the k chunks(page, heading, idx, embedding) nearest a vector."""
    score = dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
    return chunks.select("page", "heading", "idx", score.alias("score")).orderBy(F.desc("score"), "page", "idx").limit(k).select("page", "heading", "score")


def find_page(pages: DataFrame, name: str, away: int = 10) -> DataFrame:
    """The page that a name means, or else the one whose name's fingerprint is nearest, at most `away` bits off."""
    spark = pages.sparkSession
    asked = spark.createDataFrame([(name, name)], "raw_target string, target_page string")
    exact = graph.resolve_names(asked, pages).select(F.col("resolved").alias("page"), F.lit(0).alias("distance")).filter("page is not null")
    prints = search.fingerprints(pages.select(F.col("page"), F.col("page").alias("text")))
    near = search.similar(prints, name, away, 1).select(F.col("id").alias("page"), F.col("distance").cast("int"))
    return exact.unionByName(near).orderBy("distance", "page").limit(1)


def around(edges: DataFrame, pages: DataFrame, page: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, depth), suggestions(page)): a neighbourhood, and what may be meant if there is no such page."""
    known = pages.filter(F.col("page") == page)
    near = iterate.neighbourhood(edges, page, depth).join(known.select(F.lit(1).alias("_")).limit(1), F.lit(True), "left_semi")
    return near, graph.did_you_mean(pages, page)


def mixed_parsers(pages: DataFrame, hooks: dict, expected: dict[str, str]) -> DataFrame:
    """(hook, path, parser): pages(path, parser) that a hook selects and whose parser isn't the one it is for."""
    out = None
    for name, select in hooks.items():
        one = select(pages).filter(F.col("parser") != expected[name]).select(F.lit(name).alias("hook"), "path", "parser")
        out = one if out is None else out.unionByName(one)
    return out


def page_card(edges: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """One row (page, path, description, out_links, backlinks, dead_links) of the page that a name means, or none."""
    asked = pages.sparkSession.createDataFrame([(name, name)], "raw_target string, target_page string")
    hit = graph.resolve_names(asked, pages).select(F.col("resolved").alias("page")).filter("page is not null")
    # at most one row
    one = F.broadcast(hit)
    near = edges.join(one, (F.col("source") == F.col("page")) | (F.col("target") == F.col("page")), "left_semi")
    return pages.join(one, "page").select("page", "path", "description").join(graph.degrees(near, pages), "page")


def status(edges: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row: pages, links, dead links, orphans, and how many conclusions hold, definitely and at least defeasibly."""
    own = graph.stats(edges, pages, with_components=False).select("total_pages", "total_links", "dead_links", "orphan_count")
    return own.crossJoin(found.agg(F.count_if(F.col("tag") == "+D").alias("definite"), F.count_distinct(F.when(F.col("tag").isin("+D", "+d"), F.col("literal"))).alias("provable")))
