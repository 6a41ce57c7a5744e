"""A vault: pages read from a folder or a table, parsed once, as named DataFrames."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph
from ..scratch import table
from . import markdown
from .scan import ENDINGS, NEVER, Rules, reachable, scan

_LINK = "array<struct<target_page:string,raw_target:string,heading:string,block_ref:string,alias:string,is_embed:boolean,line:int,column:int,predicates:array<string>,annotation:string>>"
_HEADING = "array<struct<offset:int,line:int,level:int,text:string>>"
_LEAF = "array<struct<pos:int,type:string,level:int,language:string,ordered:boolean,start_line:int,end_line:int,hash:string,text:string,block_id:string>>"
_BLOCK = "array<struct<start_line:int,end_line:int,content:string>>"
_DIAGNOSTIC = "array<struct<level:string,message:string,line:int,column:int>>"
_CHUNK = "array<struct<idx:int,heading:string,text:string,content_hash:string>>"
PARSED = f"path string, page string, slug string, content string, frontmatter string, root_hash string, description string, links {_LINK}, headings {_HEADING}, leaves {_LEAF}, spl_blocks {_BLOCK}, diagnostics {_DIAGNOSTIC}, chunks {_CHUNK}"


def scanned(paths: DataFrame, exclude: tuple[str, ...] = (), include_hidden: bool = False, whitelist: tuple[str, ...] = (), nested: tuple[str, ...] = (), marker: str | None = None) -> DataFrame:
    """The rows of paths(path) that a scan keeps.

    A file goes if one of its folders has a name in NEVER, is a nested vault, or is hidden and not whitelisted; then if
    it matches an exclusion, which are globs, or lies in a folder of assets. Endings decide last. marker is the name of
    the folder that makes its parent a vault of its own; the vaults are given by `nested`.
    """
    never = [*NEVER, *([marker] if marker else [])]
    ok = ~F.col("path").rlike("(?:^|/)(?:" + "|".join(names._plain(x) for x in never) + ")/")
    for folder in nested:
        ok = ok & ~F.col("path").startswith(folder.rstrip("/") + "/")
    if not include_hidden:
        hidden = F.col("path").rlike(r"(?:^|/)\.[^/]+/")
        allowed = F.lit(False)
        for w in whitelist:
            allowed = allowed | F.col("path").startswith(w.rstrip("/") + "/")
        ok = ok & (~hidden | allowed)
    for pattern in ("assets/", *exclude):
        ok = ok & ~names.path_glob(F.col("path"), pattern)
    return paths.filter(ok & F.col("path").rlike("(?:" + "|".join(names._plain(e) for e in ENDINGS) + ")$"))


def read_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, content, mtime) of the files below root that a scan keeps; paths are relative.

    Where pyarrow can reach the folder, folders that a scan leaves out are neither listed nor opened. In other stores
    Spark lists all files, by their endings, and opens those that the filter on paths leaves.
    """
    if reachable(root):
        return scan(spark, root, Rules(**options))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(ENDINGS) + "}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", "^(?:[a-z]+:(?://[^/]*)?)?" + names._plain(base) + "/", "")
    return scanned(files.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime")), **options)


def parse(pages: DataFrame, parsers: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """PARSED of pages(path, content): each text is read once, by one Python pass.

    parsers turns a page's text into Markdown first, chosen by the page's `parser`, if there is such a column. A null
    text counts as empty. A file of rules is one rule block.
    """
    own = pages.select("path", F.coalesce("content", F.lit("")).alias("content"), (F.col("parser") if "parser" in pages.columns else F.lit(None).cast("string")).alias("parser"))
    own = own.select("*", names.page_name(F.col("path")).alias("page"), names.page_slug(F.col("path")).alias("slug"))
    parsers = parsers or {}

    def one(path: str, page: str, slug: str, text: str, parser: str | None) -> dict:
        if path.endswith(".spl"):
            block = [{"start_line": 1, "end_line": text.count("\n") + 1, "content": text}]
            return {"path": path, "page": page, "slug": slug, "content": text, "frontmatter": "{}", "root_hash": markdown.leaf_hash("rules", text), "description": "", "links": [], "headings": [], "leaves": [], "spl_blocks": block, "diagnostics": [], "chunks": []}
        if parser in parsers:
            text = parsers[parser](text)
        masked, meta, leaves = markdown.mask(text), markdown.frontmatter(text), markdown.leaves(text)
        said = meta.get("description")
        return {
            "path": path, "page": page, "slug": slug, "content": text, "frontmatter": json.dumps(meta, ensure_ascii=False), "root_hash": markdown.leaf_hash("root", "\n".join(x["hash"] for x in leaves)),
            "description": markdown.description(text, said if isinstance(said, str) else None), "links": markdown.links(text, masked), "headings": markdown.headings(text, masked), "leaves": leaves,
            "spl_blocks": markdown.rule_blocks(text), "diagnostics": markdown.diagnostics(text), "chunks": markdown.chunks(text),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(*row) for row in zip(b["path"], b["page"], b["slug"], b["content"], b["parser"], strict=True)], columns=[c.split()[0] for c in PARSED.split(", ")])

    return own.mapInPandas(run, PARSED)


def references(pages: DataFrame, parsers: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """(path, source, raw, named, n): how often a page says a target, as in the links of parse(). Only links are looked for.

    Texts that can't have any don't go to Python.
    """
    parsers = parsers or {}
    parser = F.col("parser") if "parser" in pages.columns else F.lit(None).cast("string")
    may = ~F.col("path").endswith(".spl") & (F.col("content").contains("[[") | F.coalesce(parser.isin(list(parsers)), F.lit(False)))
    own = pages.filter(may).select("path", names.page_name(F.col("path")).alias("source"), F.coalesce("content", F.lit("")).alias("content"), parser.alias("parser"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, source, text, name in zip(*(b.column(c).to_pylist() for c in ("path", "source", "content", "parser")), strict=True):
                said = Counter(markdown.targets(parsers[name](text) if name in parsers else text))
                rows += [(path, source, raw, named, n) for (raw, named), n in said.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "source", "raw", "named", "n"])

    return own.mapInArrow(run, "path string, source string, raw string, named string, n long")


def choose_parser(pages: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """pages(path, frontmatter) with `parser`: what the front matter names, else the first rule whose glob fits, else the default."""
    fits = [F.when(names.glob(F.col("path"), g), F.lit(p)) for g, p in rules]
    return pages.withColumn("parser", F.coalesce(F.get_json_object("frontmatter", "$.parser"), *fits, F.lit(default)))


class Vault:
    """Pages and what is in them. Frames are lazy; the parsed pages are written once."""

    def __init__(self, pages: DataFrame, parsers: dict[str, Callable[[str], str]] | None = None):
        self.source, self.parsers = pages, parsers

    @classmethod
    def folder(cls, spark: SparkSession, root: str, **options) -> Vault:
        return cls(read_folder(spark, root, **options))

    @cached_property
    def parsed(self) -> DataFrame:
        return table(parse(self.source, self.parsers), "parsed")

    @cached_property
    def pages(self) -> DataFrame:
        return self.parsed.select("page", "path", "slug", "content", "frontmatter", "root_hash", "description")

    def _each(self, column: str) -> DataFrame:
        return self.parsed.select("path", "page", F.posexplode(column).alias("ord", "x")).select("path", "page", "ord", "x.*")

    @cached_property
    def links(self) -> DataFrame:
        return self._each("links").withColumnRenamed("page", "source")

    @cached_property
    def references(self) -> DataFrame:
        """(path, source, raw, named, n): what pages say, without the rest of their parts."""
        return references(self.source, self.parsers)

    @cached_property
    def headings(self) -> DataFrame:
        return self._each("headings")

    @cached_property
    def leaves(self) -> DataFrame:
        return self._each("leaves").drop("ord")

    @cached_property
    def spl_blocks(self) -> DataFrame:
        return self._each("spl_blocks")

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._each("diagnostics")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._each("chunks").drop("ord")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.build_edges(self.links, self.pages)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.nodes(self.edges, self.pages)

    @cached_property
    def tags(self) -> DataFrame:
        listed = F.from_json(F.get_json_object("frontmatter", "$.tags"), "array<string>")
        return self.parsed.select("slug", F.explode(listed).alias("tag")).select("slug", F.trim("tag").alias("tag")).filter("tag <> ''")


def changed(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, state) of current(path, mtime, root_hash) against cached ones.

    `new` and `reparse` need parsing; `hit` has the same time, `unchanged` another time and the same hash. A page of
    Markdown without a hash in the cache is parsed again even at the same time.
    """
    old = cached.select("path", F.col("mtime").alias("_t"), F.col("root_hash").alias("_h"), F.lit(True).alias("_c"))
    rootless = F.col("path").endswith(".md") & F.col("_h").isNull()
    state = F.when(F.col("_c").isNull(), "new").when((F.col("mtime") == F.col("_t")) & ~rootless, "hit").when(F.col("root_hash") == F.col("_h"), "unchanged").otherwise("reparse")
    return current.join(old, "path", "left").select("path", state.alias("state"))


CACHE_VERSION = 2


def save_cache(parsed: DataFrame, path: str) -> None:
    parsed.withColumn("cache_version", F.lit(CACHE_VERSION)).write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached pages, or None if they are of another version."""
    df = spark.read.parquet(path)
    return None if "cache_version" not in df.columns or not df.filter(F.col("cache_version") != CACHE_VERSION).isEmpty() else df.drop("cache_version")


def newest(snapshots: DataFrame, keep: int = 100) -> DataFrame:
    """Of snapshots(vault_root_hash, used_at), those that an LRU cache of `keep` entries still has."""
    top = snapshots.groupBy("vault_root_hash").agg(F.max("used_at").alias("used_at"))
    return top.orderBy(F.desc("used_at"), "vault_root_hash").limit(keep)


def generate(spark: SparkSession, pages: int = 1000, links_each: int = 12, phantom: float = 0.2, seed: int = 42) -> DataFrame:
    """(path, content) of a synthetic vault: notes in folders of 100 with links drawn from a seed, some to pages that aren't there."""
    draw = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1_000_000)) / 1e6
    ids = spark.range(pages).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(links_each))))
    to = F.when(draw("id", "j") < phantom, F.concat(F.lit("ghost_"), F.floor(draw("j", "id") * pages).cast("string"))).otherwise(F.concat(F.lit("note_"), F.floor(draw("j", "id") * pages).cast("string")))
    body = ids.select("id", "j", F.concat(F.lit("- see [["), to, F.lit("]]")).alias("line"))
    text = body.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "line"))).alias("ls")).select("id", F.concat(F.lit("# Note "), F.col("id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    return text.select(F.format_string("folder_%d/note_%d.md", F.floor(F.col("id") / 100), F.col("id")).alias("path"), "content")


def first_path(pages: DataFrame) -> DataFrame:
    first = Window.partitionBy("page").orderBy("path")
    return pages.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("page", "path")
