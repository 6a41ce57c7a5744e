"""Merging of shards, document trees, percentiles and budgets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What one extension may keep for later stages.
SHARD_BYTES = 16 << 20


def shard_sizes(shards: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """(ext, seq, bytes, counts): how large each shard is, and whether last_writer_wins reads it."""
    size = F.sum(F.octet_length("key") + F.octet_length("value"))
    return shards.groupBy("ext", "seq").agg(size.alias("bytes")).withColumn("counts", F.col("bytes") <= most)


def last_writer_wins(shards: DataFrame, most: int | None = SHARD_BYTES) -> DataFrame:
    """(ext, key, value) of shards(ext, key, value, seq): the value of the highest seq.

    Shards of more than `most` bytes don't count, and shard_sizes tells which; with None all do.
    """
    if most is not None:
        shards = shards.join(shard_sizes(shards, most).filter("counts"), ["ext", "seq"], "left_semi")
    return shards.groupBy("ext", "key").agg(F.max_by("value", "seq").alias("value"))


def nearest_rank(c: str, share: float) -> Column:
    """The nearest-rank percentile, 0 for no rows."""
    return F.coalesce(F.expr(f"percentile_disc({share}) within group (order by `{c}`)"), F.lit(0))


def budget_gate(timings: DataFrame, budget: float) -> DataFrame:
    """(hook, p50, p95, within) of timings(hook, ms)."""
    return timings.groupBy("hook").agg(nearest_rank("ms", 0.5).alias("p50"), nearest_rank("ms", 0.95).alias("p95")).withColumn("within", F.col("p95") <= budget)


NODE = "path string, place string, kind string, attrs string"


def flatten(docs: DataFrame) -> DataFrame:
    """(path, place, kind, attrs) of each node of docs(path, tree), trees as JSON objects with `type` and `children`."""

    def nodes(path: str, tree: dict, place: str) -> Iterator[tuple]:
        yield path, place, str(tree.get("type")), json.dumps({k: v for k, v in tree.items() if k not in ("type", "children")}, sort_keys=True)
        for i, child in enumerate(tree.get("children") or []):
            if isinstance(child, dict):
                yield from nodes(path, child, f"{place}/{i}")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([n for p, t in zip(b["path"], b["tree"], strict=True) for n in nodes(p, json.loads(t), "")], columns=["path", "place", "kind", "attrs"])

    return docs.select("path", "tree").mapInPandas(run, NODE)


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, place, change, before, after): nodes compared by their place; another kind is a removal and an addition."""
    a, b = flatten(old), flatten(new)
    o = a.select("path", "place", F.col("kind").alias("ok"), F.col("attrs").alias("before"))
    both = b.join(o, ["path", "place"], "full")
    same = F.col("ok") == F.col("kind")
    changes = F.when(F.col("ok").isNull(), F.array(F.lit("added"))).when(F.col("kind").isNull(), F.array(F.lit("removed"))).when(~same, F.array(F.lit("removed"), F.lit("added"))).when(F.col("attrs") != F.col("before"), F.array(F.lit("modified")))
    return both.select("path", "place", F.explode(changes).alias("change"), "before", F.col("attrs").alias("after"))
