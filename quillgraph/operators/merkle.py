"""Content hashes of blocks, sections and files: groundings, references by id or hash, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import source_ref_class
from ..scratch import table


def file_roots(leaves: DataFrame) -> DataFrame:
    """(path, root_hash): the hash of a file's block hashes in order."""
    return leaves.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("x")).select("path", F.sha2(F.concat_ws("\n", F.transform("x", lambda e: e["hash"])), 256).alias("root_hash"))


def vault_root(roots: DataFrame) -> DataFrame:
    """One row with the hash of all files, whatever their order: sums of their hashes' parts, so no task holds all."""
    each = F.sha2(F.concat_ws("\n", "path", "root_hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring(each, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return roots.agg(F.count("*").alias("files"), *(part(i).alias(f"s{i}") for i in range(8))).select("files", F.sha2(F.concat_ws(",", F.col("files").cast("string"), *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(8))), 256).alias("vault_root_hash"))


LEVELS = range(1, 7)


def sections(leaves: DataFrame) -> DataFrame:
    """(path, section, heading_pos, level, heading, first, last): from each heading to the next of its level or above.

    What stands before the first heading is section 0, without one. `last` includes deeper sections.
    """
    heads = leaves.filter("type = 'heading'").select("path", F.col("pos").alias("heading_pos"), "level", F.col("text").alias("heading"))
    # backwards through a file, the last heading met of each level or above is the next one
    later = Window.partitionBy("path").orderBy(F.desc("heading_pos")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.array(*(F.last(F.when(F.col("level") <= k, F.col("heading_pos")), ignorenulls=True).over(later) for k in LEVELS))
    numbered = heads.withColumn("stop", F.get(nxt, F.col("level") - 1)).withColumn("section", F.row_number().over(Window.partitionBy("path").orderBy("heading_pos")))
    size = leaves.groupBy("path").agg(F.min(F.when(F.col("type") == "heading", F.col("pos"))).alias("h"), (F.max("pos") + 1).alias("n"))
    own = numbered.join(size, "path").select("path", "section", "heading_pos", "level", "heading", F.col("heading_pos").alias("first"), (F.coalesce("stop", "n") - 1).alias("last"))
    intro = size.filter("h is null or h > 0")
    return own.unionByName(intro.select("path", F.lit(0).alias("section"), F.lit(None).cast("int").alias("heading_pos"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("first"), (F.coalesce("h", "n") - 1).alias("last")))


def groundings(leaves: DataFrame) -> DataFrame:
    """(path, pos, start_line, ast_hash, grounding): each rule block with the hash of the section around it.

    The section is that of the nearest heading before the block; rule blocks don't count towards its hash. A block
    lies in the sections of the last heading of each level before it, as far as these reach.
    """
    # all of it lies with the file, so leaves move once
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    is_head, is_rules = F.col("type") == "heading", F.coalesce(F.col("type") == "rules", F.lit(False))
    nxt = F.array(*(F.last(F.when(is_head & (F.col("level") <= k), F.col("pos")), ignorenulls=True).over(later) for k in LEVELS))
    own = leaves.select("path", "pos", "type", "level", "start_line", "hash").withColumn("stop", F.when(is_head, F.get(nxt, F.col("level") - 1)))
    over = F.array(*(F.last(F.when(is_head & (F.col("level") == k), F.struct(F.col("pos").alias("h"), "stop")), ignorenulls=True).over(upto) for k in LEVELS))
    marked = own.withColumn("h", F.coalesce(F.last(F.when(is_head, F.col("pos")), ignorenulls=True).over(upto), F.lit(-1))).withColumn("over", over)
    around = F.transform(F.filter("over", lambda o: o.isNotNull() & (o["stop"].isNull() | (F.col("pos") < o["stop"]))), lambda o: o["h"])
    at = F.when(is_rules | (F.col("h") == -1), F.array("h")).otherwise(around)
    by = marked.select("path", F.explode(at).alias("h"), is_rules.alias("rules"), "pos", "start_line", "hash").groupBy("path", "h")
    both = by.agg(F.sort_array(F.collect_list(F.when(~F.col("rules"), F.struct("pos", "hash")))).alias("x"), F.collect_list(F.when(F.col("rules"), F.struct("pos", "start_line", F.col("hash").alias("ast_hash")))).alias("blocks"))
    text = F.when(F.size("x") > 0, F.sha2(F.concat_ws("\n", F.transform("x", lambda e: e["hash"])), 256))
    return both.filter(F.size("blocks") > 0).select("path", text.alias("grounding"), F.explode("blocks").alias("b")).select("path", "b.*", "grounding")


#: Lines are below 2**40.
LINE_LEVELS = 40


def _pieces(start: Column, end: Column) -> Column:
    """The lines from start to end as disjoint blocks (level, index): block i of level k is [i * 2**k, (i + 1) * 2**k).

    Level by level, from both ends inwards, the block that has no sibling in what is left is taken.
    """

    def step(s: Column, k: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        taken = F.array_compact(F.array(F.when(left, a), F.when(right, b - 1)))
        halved = lambda x: F.shiftright(x, 1)
        return F.struct(
            halved(F.when(left, a + 1).otherwise(a)).alias("a"), halved(F.when(right, b - 1).otherwise(b)).alias("b"),
            F.concat(s["out"], F.transform(taken, lambda i: F.struct(k.alias("level"), i.alias("index")))).alias("out"),
        )

    first = F.struct(start.cast("long").alias("a"), (end.cast("long") + 1).alias("b"), F.array().cast("array<struct<level:int,index:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LINE_LEVELS)), first, step, lambda s: s["out"])


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(path, line, ...) with the columns of each span(path, start_line, end_line, ...) around the line; nulls if there is none.

    A span is cut into blocks of powers of two lines, at most two of each size, and a point asks for the one block of
    each size that it lies in, so they meet by equality: work follows points, spans and the pairs that are found, also
    in a file that has a large share of both. Lines are 0 or more; a span that ends before it starts, or lacks an end,
    holds nothing.
    """
    extra = [c for c in spans.columns if c != "path"]
    known = spans.filter("start_line <= end_line").select(F.col("path").alias("_path"), F.struct(*extra).alias("_span"), F.explode(_pieces(F.col("start_line"), F.col("end_line"))).alias("_b"))
    cut = table(known.select("_path", F.col("_b.level").alias("_level"), F.col("_b.index").alias("_index"), "_span"), "pieces")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 41 at most
    rows = table(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    asks = rows.select("_row", F.col("path").alias("_path"), F.col("line").cast("long").alias("_line"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level")).withColumn("_index", F.expr("shiftright(_line, _level)"))
    hits = table(asks.join(cut, ["_path", "_level", "_index"]).select("_row", "_span"), "hits")
    return rows.join(hits, "_row", "left").select(*points.columns, *(F.col(f"_span.{c}").alias(c) for c in extra))


def resolve_block_ids(refs: DataFrame, leaves: DataFrame) -> DataFrame:
    """refs(path, block_id, ...) with the hash of the first block of that id in that file; null if there is none."""
    first = leaves.filter("block_id is not null").groupBy("path", "block_id").agg(F.min_by("hash", "pos").alias("hash"))
    return refs.join(first, ["path", "block_id"], "left")


def resolve_prefixes(refs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(prefix, n_hashes, status, hash): how many different block hashes begin so; found with exactly one.

    Prefixes have at least 8 digits, so the join is on those and the rest is compared in each bucket.
    """
    hashes = leaves.select("hash", F.substring("hash", 1, 8).alias("k")).distinct()
    asked = refs.select("prefix").distinct().withColumn("k", F.lower(F.substring("prefix", 1, 8)))
    hit = asked.join(hashes, "k", "left").filter(F.col("hash").isNull() | F.col("hash").startswith(F.lower("prefix")))
    n = hit.groupBy("prefix").agg(F.count_distinct("hash").alias("n_hashes"), F.min("hash").alias("h"))
    full = asked.select("prefix").join(n, "prefix", "left").select("prefix", F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"), "h")
    status = F.when(F.col("n_hashes") == 0, "not_found").when(F.col("n_hashes") == 1, "found").otherwise("ambiguous")
    return full.select("prefix", "n_hashes", status.alias("status"), F.when(F.col("n_hashes") == 1, F.col("h")).alias("hash"))


def check_references(refs: DataFrame, leaves: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, ref, class, ok) of refs(path, ref), each by its kind: local ids, ids in other pages, pages, hashes."""
    kinds = refs.select("path", "ref", source_ref_class(F.col("ref")).alias("class"))
    inner = F.regexp_extract("ref", r"^\[\[([^\]^#|]*)", 1)
    told = kinds.withColumn("page", F.trim(inner)).withColumn("block_id", F.regexp_extract("ref", r"\^([A-Za-z0-9-]+)", 1))
    place = pages.select("page", F.col("path").alias("target")).dropDuplicates(["page"])
    ids = leaves.filter("block_id is not null").select(F.col("path").alias("at"), F.col("block_id").alias("id")).distinct()
    there = told.join(place, "page", "left").withColumn("at", F.when(F.col("class") == "local", F.col("path")).otherwise(F.col("target")))
    known = there.join(ids.withColumn("hit", F.lit(True)), (there["at"] == ids["at"]) & (there["block_id"] == ids["id"]), "left").drop(ids["at"])
    prefixes = resolve_prefixes(kinds.filter("class = 'hash'").select(F.col("ref").alias("prefix")), leaves).select(F.col("prefix").alias("ref"), "status")
    ok = F.when(F.col("class").isin("local", "cross_file"), F.coalesce("hit", F.lit(False))).when(F.col("class") == "page", F.col("target").isNotNull()).when(F.col("class") == "hash", F.col("status") == "found").otherwise(False)
    return known.join(prefixes, "ref", "left").select("path", "ref", "class", ok.alias("ok"))


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rule blocks that stayed the same while their section changed: (path, start_line, ast_hash)."""
    old = baseline.select("path", "start_line", F.col("ast_hash").alias("_a"), F.col("grounding").alias("_g"))
    return current.join(old, ["path", "start_line"]).filter(F.col("ast_hash") == F.col("_a")).filter(~F.col("grounding").eqNullSafe(F.col("_g"))).select("path", "start_line", "ast_hash")


def explicit_drift(declared: DataFrame, leaves: DataFrame) -> DataFrame:
    """declared(path, line, target_path, block_id, hash): references whose block is gone or has another hash."""
    now = resolve_block_ids(declared.select(F.col("target_path").alias("path"), "block_id").distinct(), leaves).select(F.col("path").alias("target_path"), "block_id", F.col("hash").alias("now"))
    joined = declared.join(now, ["target_path", "block_id"], "left")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("hash"), "changed")
    return joined.withColumn("drift", kind).filter("drift is not null").select("path", "line", "target_path", "block_id", "drift")


def blocks_of(leaves: DataFrame, kind: str) -> DataFrame:
    """The blocks of one type; the filter reaches the scan."""
    return leaves.filter(F.col("type") == kind)


def grounded_counts(grounded: DataFrame, live: DataFrame, declared: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: rule_blocks, grounded_blocks, grounded_facts, broken_groundings.

    grounded(path, start_line, grounding) and declared(path, start_line, target_path, hash) may be of an earlier state:
    only blocks that live(path, start_line) still has count. A declared grounding is broken if its file has no block of
    that hash now, whether or not its own block lives.
    """
    here = live.select("path", "start_line").distinct()
    blocks = grounded.join(here, ["path", "start_line"], "left_semi").agg(F.count("grounding").alias("grounded_blocks"))
    facts = declared.join(here, ["path", "start_line"], "left_semi").agg(F.count("*").alias("grounded_facts"))
    hashes = leaves.select(F.col("path").alias("target_path"), "hash").distinct()
    broken = declared.join(hashes, ["target_path", "hash"], "left_anti").agg(F.count("*").alias("broken_groundings"))
    return live.agg(F.count("*").alias("rule_blocks")).crossJoin(blocks).crossJoin(facts).crossJoin(broken)
