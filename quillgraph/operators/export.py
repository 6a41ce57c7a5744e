"""Written forms: JSON documents of graphs and histories, logs of events, indexes on disk."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feed, graph, history, search


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("append").text(path)


def graph_json(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(part, value): the export as rows of JSON, its nodes, its distinct edges and their counts."""
    nodes, links = graph.export_graph(edges, pages)
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("edges")))
    part = lambda name, df: json_lines(df).select(F.lit(name).alias("part"), "value")
    return part("node", nodes).unionByName(part("edge", links)).unionByName(part("counts", counts))


def index_json(edges: DataFrame, pages: DataFrame, tags: DataFrame | None = None, typed: bool = True) -> DataFrame:
    """(part, value): the graph index, nodes with their flags and tags, and one edge a key."""
    nodes = graph.index_nodes(edges, pages)
    if tags is not None:
        nodes = nodes.join(tags.groupBy("page").agg(F.sort_array(F.collect_set("tag")).alias("tags")), "page", "left")
    part = lambda name, df: json_lines(df).select(F.lit(name).alias("part"), "value")
    return part("node", nodes).unionByName(part("edge", graph.index_edges(edges, typed)))


def history_json(snapshots: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """(part, value): the vault's trend and each page's, in `most` points from its first to its last change."""
    vault = history.sample_trend(history.vault_history(snapshots, links), most)
    events = history.page_history(snapshots, links).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("all"))
    n = F.size("all")
    at = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: F.when(n <= most, i).otherwise(F.floor(i * (n - 1) / max(1, most - 1)).cast("int")))
    pages = events.select("page", F.transform(at, lambda i: F.get("all", i)).alias("points"))
    part = lambda name, df: json_lines(df).select(F.lit(name).alias("part"), "value")
    return part("vault", vault).unionByName(part("page", pages))


def catalog(scopes: DataFrame, items: DataFrame) -> DataFrame:
    """(scope, prefix, items): the feeds there are, with how many visible pages each has."""
    n = feed.below(items, scopes).groupBy("scope").agg(F.count("*").alias("items"))
    return scopes.join(n, "scope", "left").select("scope", "prefix", F.coalesce("items", F.lit(0)).alias("items"))


#: Files of an index: terms are dealt out by hash, so a query reads the files of its terms.
SHARDS = 64


def build_index(docs: DataFrame, path: str, id_col: str = "page", text_col: str = "text") -> None:
    """Postings of rows and totals on disk, by shard of the term: postings are moved once."""
    p = search.row_postings(docs, id_col, text_col).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int"))
    p.repartition(F.col("shard"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    docs.agg(F.count("*").alias("n"), F.avg(F.size(search.tokens(F.col(text_col)))).alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")


def query_index(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """bm25 over an index on disk; only the shards of the query's terms are read."""
    terms = sorted({t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    shards = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(SHARDS)).cast("int")).distinct().collect()] if terms else []
    totals = spark.read.parquet(f"{path}/totals").first()
    index = spark.read.parquet(f"{path}/postings").filter(F.col("shard").isin(shards) & F.col("term").isin(terms)).drop("shard")
    return search.bm25(search.whole_postings(index), totals["n"], totals["mean"] or 1.0, query, limit)


def page_predicates(links: DataFrame) -> DataFrame:
    """(source, predicates): the distinct predicates of each page, in the order of their first line."""
    each = links.select("source", "line", F.posexplode("predicates").alias("i", "p")).groupBy("source", "p").agg(F.min(F.struct("line", "i")).alias("at"))
    return each.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("x")).select("source", F.transform("x", lambda e: e["p"]).alias("predicates"))


def build_vectors(chunks: DataFrame, known: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str) -> None:
    """A vector index on disk of chunks(path, idx, heading, text, content_hash): vectors of equal texts are those of known(content_hash, embedding).

    Only new texts are embedded, each once, by `embed`, which gets a batch of texts in a task.
    """

    def made(batches):
        for b in batches:
            yield pd.DataFrame({"content_hash": b["content_hash"], "embedding": embed(b["text"].tolist())})

    old = known.select("content_hash", "embedding").dropDuplicates(["content_hash"])
    fresh = chunks.join(old, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("text").alias("text"))
    every = old.unionByName(fresh.mapInPandas(made, "content_hash string, embedding array<float>"))
    chunks.select("path", "idx", "heading", "content_hash").join(every, "content_hash").write.mode("overwrite").parquet(path)


def store_snapshot(index: DataFrame, root: str, vault_root_hash: str) -> None:
    """Keep the parsed pages of one state of a vault under its hash."""
    index.write.mode("overwrite").parquet(f"{root}/{vault_root_hash}")


def _snapshots(spark: SparkSession, root: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted(((s.getModificationTime(), s.getPath().getName(), s.getPath()) for s in fs.listStatus(at)), reverse=True) if fs.exists(at) else []


def load_snapshot(spark: SparkSession, root: str, vault_root_hash: str) -> DataFrame | None:
    """The pages kept under a hash; None if there are none."""
    _, found = _snapshots(spark, root)
    return spark.read.parquet(f"{root}/{vault_root_hash}") if any(name == vault_root_hash for _, name, _ in found) else None


def evict_snapshots(spark: SparkSession, root: str, keep: int = 100) -> list[str]:
    """Remove all but the newest `keep` kept states; returns the hashes that went. The driver lists folders, not rows."""
    fs, found = _snapshots(spark, root)
    for _, _, at in found[keep:]:
        fs.delete(at, True)
    return [name for _, name, _ in found[keep:]]
