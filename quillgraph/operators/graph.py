"""Typed link graphs: building them from links, and what is asked of them without rounds.

A graph is two tables: pages(page, path) and edges(source, target, predicate, annotation, line, ...), a multigraph with
one row for each link and predicate. A target without a page is a ghost. All of this is joins and grouped aggregates;
sorting happens at the sink only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_names(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links(raw_target, target_page) with `resolved`: the page that a name means, or null.

    Four steps, each an equi-join on one key of the pages: the lower-cased name, the normalised name and, for raw texts
    with a slash, the lower-cased and the normalised path without its ending. The first step with a match decides; it
    resolves only if exactly one page matches. A raw target's meaning is that of its first resolvable target_page.
    """
    low, norm = lambda c: F.lower(c), lambda c: F.translate(F.lower(c), "-_", "  ")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    asked = links.select("raw_target", "target_page").distinct()
    keys = [(low, F.col("page"), None), (norm, F.col("page"), None), (low, stem, "/"), (norm, stem, "/")]
    found = asked
    for i, (key, of, needs) in enumerate(keys):
        table_ = pages.groupBy(key(of).alias(f"k{i}")).agg(F.count("*").alias(f"n{i}"), F.min("page").alias(f"p{i}"))
        ask = key(F.col("target_page"))
        found = found.withColumn(f"k{i}", F.when(F.col("raw_target").contains(needs), ask) if needs else ask).join(table_, f"k{i}", "left")
    first = F.coalesce(*(F.when(F.col(f"n{i}").isNotNull(), F.struct(F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p"))) for i in range(4)))
    one = found.select("raw_target", "target_page", F.when(first["n"] == 1, first["p"]).alias("resolved"))
    per_raw = one.groupBy("raw_target").agg(F.min(F.when(F.col("resolved").isNotNull(), F.struct("target_page", "resolved")))["resolved"].alias("resolved"))
    return links.join(per_raw, "raw_target", "left")


def build_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """edges of links(source, target_page, raw_target, predicates, ...): one for each predicate, or one untyped.

    A link to a heading of its own page, with an empty target and a `#`, is a self edge; what doesn't resolve points to
    its target's text.
    """
    known = resolve_names(links, pages)
    target = F.when((F.col("target_page") == "") & F.col("raw_target").startswith("#"), F.col("source")).otherwise(F.coalesce("resolved", "target_page"))
    typed = known.withColumn("target", target).withColumn("predicate", F.explode_outer("predicates"))
    return with_ghosts(typed.drop("predicates", "resolved"), pages)


def with_ghosts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    here = pages.select(F.col("page").alias("target"), F.lit(False).alias("_ghost")).distinct()
    return edges.join(here.hint("shuffle_hash"), "target", "left").withColumn("is_ghost", F.coalesce("_ghost", F.lit(True))).drop("_ghost")


def nodes(edges: DataFrame, pages: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("page")).unionByName(edges.select(F.col("target").alias("page"))).unionByName(pages.select("page")).distinct()
    return ends.join(pages.select("page", F.lit(True).alias("_r")).distinct(), "page", "left").select("page", F.coalesce("_r", F.lit(False)).alias("is_resolved"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source", "target", F.asc_nulls_first("predicate"), "line")


def edge_filter(edges: DataFrame, predicates: list[str] | None = None, untyped: bool = False, annotated: bool = False, source: str | None = None, target: str | None = None) -> DataFrame:
    """All conditions hold; one of the predicates suffices; names compare without case."""
    if untyped:
        edges = edges.filter(F.col("predicate").isNull())
    if annotated:
        edges = edges.filter(F.col("annotation").isNotNull())
    if predicates:
        edges = edges.filter(F.col("predicate").isin(predicates))
    for name, want in (("source", source), ("target", target)):
        if want is not None:
            edges = edges.filter(F.lower(name) == want.lower())
    return edges


def dead_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    # hashed, pages take the memory of a task; sorted, links would. An anti join would be done for each part of a union of
    # links, and beside a small one the pages would be hashed in a few tasks
    return with_ghosts(edges, pages).filter("is_ghost").drop("is_ghost")


def degrees(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, out_links, backlinks, dead_links) of each page, counting edges."""
    known = with_ghosts(edges.select("source", "target"), pages)
    out = known.groupBy(F.col("source").alias("page")).agg(F.count("*").alias("out_links"), F.count_if("is_ghost").alias("dead_links"))
    back = known.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("backlinks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("page").distinct().join(out, "page", "left").join(back, "page", "left").select("page", zero("out_links"), zero("backlinks"), zero("dead_links"))


def orphans(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, out_links) of pages that no edge reaches; an edge to itself counts."""
    mark = lambda df, c, what: df.select(F.col(c).alias("page"), *(F.lit(int(what == n)).alias(n) for n in ("paged", "out", "back")))
    ends = mark(edges.filter("source is not null"), "source", "out").unionByName(mark(edges.filter("target is not null"), "target", "back"))
    per = mark(pages, "page", "paged").unionByName(ends).groupBy("page").agg(F.max("paged").alias("paged"), F.sum("out").alias("out_links"), F.max("back").alias("back"))
    return per.filter("paged = 1 and back = 0").select("page", "out_links")


def forward_links(edges: DataFrame, page: str) -> DataFrame:
    return edges.filter(F.col("source") == page)


def backlinks(edges: DataFrame, page: str) -> DataFrame:
    return edges.filter(F.col("target") == page)


def most_linked(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("backlink_count")).orderBy(F.desc("backlink_count"), "page").limit(n)


def by_predicate(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("predicate"))


def stats(edges: DataFrame, pages: DataFrame, top: int = 10, with_components: bool = True) -> DataFrame:
    """One row: pages, links, unique_targets, dead_links, ambiguous_links, orphans, connected_components, most_linked.

    Edges are counted by target once; totals, ghosts, orphans and the most linked all come from those counts.
    """
    from ..scratch import table
    from .iterate import named_groups

    edges = table(edges.select("source", "target"), "edges")  # read three times, made once
    per = edges.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("n")).filter("page is not null")
    known = table(pages.select("page", F.lit(True).alias("paged")).distinct().join(per, "page", "full"), "targets")
    out = known.agg(
        F.count_if("paged").alias("total_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_links"), F.count("n").alias("unique_targets"),
        F.coalesce(F.sum(F.when(F.col("paged").isNull(), F.col("n"))), F.lit(0)).alias("dead_links"), F.count_if(F.col("n").isNull()).alias("orphan_count"),
    ).withColumn("ambiguous_links", F.lit(0))
    best = known.filter("n is not null").orderBy(F.desc("n"), "page").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "page"))).alias("b"))
    out = out.crossJoin(best.select(F.transform("b", lambda x: F.struct(x["page"].alias("page"), (-x["k"]).alias("backlink_count"))).alias("most_linked")))
    if with_components:
        names, groups = named_groups(edges, "source", "target")  # counted by number: their roots' names aren't asked for
        # a page or an end of a loop without an edge to another stands alone
        ends = known.select("page").unionByName(edges.filter("source = target").select(F.col("source").alias("page"))).distinct()
        alone = ends.join(names.select(F.col("name").alias("page")), "page", "left_anti").agg(F.count("*").alias("alone"))
        joined = groups.select("level", "group").distinct().agg(F.count("*").alias("joined"))
        out = out.crossJoin(joined.crossJoin(alone).select((F.col("joined") + F.col("alone")).alias("connected_components")))
    return out


def backlink_groups(edges: DataFrame, page: str) -> DataFrame:
    """(source, n, first_line, predicate): who links to page, how often, where first, and by which predicate first."""
    own = backlinks(edges, page)
    return own.groupBy("source").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.min(F.when(F.col("predicate").isNotNull(), F.struct("line", "predicate")))["predicate"].alias("predicate"))


def predicate_groups(edges: DataFrame, page: str) -> DataFrame:
    """(predicate, pages): the targets of page by predicate; links without one are under `__untyped`."""
    own = forward_links(edges, page).select(F.coalesce("predicate", F.lit("__untyped")).alias("predicate"), "target").distinct()
    return own.groupBy("predicate").agg(F.sort_array(F.collect_list("target")).alias("pages"))


def folder_rollup(pages: DataFrame, prefix: str = "") -> DataFrame:
    """(folder, n): pages below each immediate subfolder of prefix."""
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    return pages.filter(F.col("path").startswith(prefix)).select(rest.alias("rest")).filter(F.col("rest").contains("/")).groupBy(F.split("rest", "/")[0].alias("folder")).agg(F.count("*").alias("n"))


def folder_tree(pages: DataFrame) -> DataFrame:
    """(folder, depth, n_pages, n_direct) of every folder on any path."""
    parts = F.split("path", "/")
    each = pages.select(parts.alias("p")).filter(F.size("p") > 1)
    up = each.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    return up.groupBy(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"), "depth").agg(F.count("*").alias("n_pages"), F.count_if(F.col("depth") == F.size("p") - 1).alias("n_direct"))


def tag_cloud(tags: DataFrame) -> DataFrame:
    """(tag, n): distinct pages of each tag of tags(slug, tag), trimmed and not empty."""
    clean = tags.select("slug", F.trim("tag").alias("tag")).filter("tag <> ''")
    return clean.groupBy("tag").agg(F.count_distinct("slug").alias("n")).orderBy(F.desc("n"), F.lower("tag"))


def export_graph(edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(page, path), distinct edges(source, target)) of the JSON export."""
    every = nodes(edges, pages).join(pages.groupBy("page").agg(F.min("path").alias("path")), "page", "left").select("page", "path")
    return every, edges.select("source", "target").distinct()


def index_edges(edges: DataFrame, typed: bool) -> DataFrame:
    """Edges of the graph index, one for each key, that of the lowest line.

    The key is `s->t`, or `s--t--p` if predicates tell edges apart.
    """
    by = ["source", "target", *["predicate"] * typed]
    first = Window.partitionBy(*by).orderBy("line", F.asc_nulls_first("predicate"))
    key = F.concat_ws("--", "source", "target", F.coalesce("predicate", F.lit(""))) if typed else F.concat_ws("->", "source", "target")
    return edges.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(key.alias("key"), "source", "target", "predicate", "line")


def index_nodes(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, outgoing, backlinks, is_orphan, has_dead_links) of each page."""
    return degrees(edges, pages).select("page", F.col("out_links").alias("outgoing"), "backlinks", (F.col("backlinks") == 0).alias("is_orphan"), (F.col("dead_links") > 0).alias("has_dead_links"))


def did_you_mean(pages: DataFrame, name: str, n: int = 5) -> DataFrame:
    """Pages whose name holds `name` or is held by it, without case."""
    want, page = F.lower(F.lit(name)), F.lower("page")
    return pages.filter(page.contains(want) | want.contains(page)).select("page").distinct().orderBy("page").limit(n)


def graph_diff(old_edges: DataFrame, old_pages: DataFrame, new_edges: DataFrame, new_pages: DataFrame) -> DataFrame:
    """(change, a, b): the eight differences of two graphs, as sets of pages, links, orphans and dead links."""

    def marks(change: str, frame: DataFrame, two: bool) -> DataFrame:
        first, *rest = frame.columns
        return frame.select(F.lit(change).alias("change"), F.col(first).alias("a"), (F.col(rest[0]) if two else F.lit(None).cast("string")).alias("b"))

    def both(frames: tuple[DataFrame, DataFrame], gone: str, come: str, two: bool) -> list[DataFrame]:
        old, new = frames
        return [marks(gone, old.subtract(new), two), marks(come, new.subtract(old), two)]

    pairs = lambda e: e.select("source", "target")
    parts = [
        *both((old_pages.select("page"), new_pages.select("page")), "page_removed", "page_added", False),
        *both((pairs(old_edges), pairs(new_edges)), "link_removed", "link_added", True),
        *both((orphans(old_edges, old_pages).select("page"), orphans(new_edges, new_pages).select("page")), "orphan_resolved", "orphan_gained", False),
        *both((pairs(dead_links(old_edges, old_pages)), pairs(dead_links(new_edges, new_pages))), "dead_resolved", "dead_gained", True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dead_and_orphans(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: dead_links and orphans, how many rows these two have; links are counted by target, so none is looked up."""
    ends = pages.select("page", F.lit(True).alias("paged")).unionByName(edges.select(F.col("target").alias("page"), F.lit(False).alias("paged")))
    per = ends.groupBy("page").agg(F.bool_or("paged").alias("paged"), F.count_if(~F.col("paged")).alias("n"))
    here, met = F.col("paged") & F.col("page").isNotNull(), F.col("page").isNotNull() & (F.col("n") > 0)
    return per.agg(F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("dead_links"), F.count_if(F.col("paged") & ~met).alias("orphans"))


def check_summary(edges: DataFrame, pages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(kind, level, n): diagnostics(kind, level) with dead links and orphans, which count as errors."""
    told = diagnostics.groupBy("kind", "level").agg(F.count("*").alias("n"))
    row = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.lit("error").alias("level"), F.col(n).alias("n"))
    counted = dead_and_orphans(edges, pages).select(F.inline(F.array(row("dead_link", "dead_links"), row("orphan", "orphans")))).filter("n > 0")
    return told.unionByName(counted).groupBy("kind", "level").agg(F.sum("n").alias("n"))


#: The counters of a check, in order.
COUNTERS = (
    "dead_links", "orphans", "syntax_errors", "spl_errors", "drift_warnings", "drift_info", "total_spl_blocks", "drifted_blocks_warning", "drifted_blocks_info",
    "explicitly_grounded_facts", "broken_groundings", "predicate_errors", "predicate_warnings",
)


def check(edges: DataFrame, pages: DataFrame, diagnostics: DataFrame, blocks: DataFrame, references: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: the counters of COUNTERS, and whether a check fails that stops at errors, or at warnings.

    diagnostics(kind, level) are those of syntax, rules, drift and predicates: all of syntax count, of rules the
    errors, of the others errors, warnings and infos apart. blocks are rule blocks, references(target_path, hash) what
    facts are grounded on; a reference is broken if that file has no such block. Dead links and orphans are errors.
    """
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    kind = lambda k, *levels: (F.col("kind") == k) & (F.col("level").isin(*levels) if levels else F.lit(True))
    told = diagnostics.agg(
        n(kind("syntax")).alias("syntax_errors"), n(kind("rules", "error")).alias("spl_errors"), n(kind("drift", "warning")).alias("drift_warnings"), n(kind("drift", "info")).alias("drift_info"),
        n(kind("drift", "warning")).alias("drifted_blocks_warning"), n(kind("drift", "info")).alias("drifted_blocks_info"),
        n(kind("predicate", "error")).alias("predicate_errors"), n(kind("predicate", "warning")).alias("predicate_warnings"),
        n(kind("syntax", "error") | kind("rules", "error") | kind("predicate", "error")).alias("_errors"), n(F.col("level") == "warning").alias("_warnings"),
    )
    here = leaves.select(F.col("path").alias("target_path"), "hash").distinct()
    broken = references.join(here, ["target_path", "hash"], "left_anti").agg(F.count("*").alias("broken_groundings"))
    counted = dead_and_orphans(edges, pages).crossJoin(told)
    counted = counted.crossJoin(blocks.agg(F.count("*").alias("total_spl_blocks"))).crossJoin(references.agg(F.count("*").alias("explicitly_grounded_facts"))).crossJoin(broken)
    errors = F.col("dead_links") + F.col("orphans") + F.col("_errors") > 0
    return counted.select(*COUNTERS, errors.alias("fails_on_errors"), (errors | (F.col("_warnings") > 0)).alias("fails_on_warnings"))


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))
