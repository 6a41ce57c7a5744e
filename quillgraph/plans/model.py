"""A link graph and its history derived from the driver's tables, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: Parts above this size have no page, so links to them are dead.
PAGED = 25


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, path): a page for each region, nation, customer, supplier, order, and for parts up to a size."""
    one = lambda t, k, kind, keep="true": read(spark, d, t).filter(keep).select(_name(kind, k).alias("page"), F.concat(F.lit(f"{kind}/"), F.col(k).cast("string"), F.lit(".md")).alias("path"))
    out = one("region", "r_regionkey", "region")
    for x in (("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("supplier", "s_suppkey", "supplier"), ("orders", "o_orderkey", "order"), ("part", "p_partkey", "part", f"p_size <= {PAGED}")):
        out = out.unionByName(one(*x))
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, predicate, annotation, line) of the tables' foreign keys; suppliers also link without a predicate."""
    n, c, s, o, li = (read(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    paged = read(spark, d, "part").filter(f"p_size <= {PAGED}").select(F.col("p_partkey").alias("l_partkey"))

    def one(df: DataFrame, source: Column, target: Column, predicate: str | None, line: Column, note: Column | None = None) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(predicate).cast("string").alias("predicate"), (note if note is not None else F.lit(None)).cast("string").alias("annotation"), line.cast("int").alias("line"))

    returned = F.when(F.col("l_returnflag") == "R", "returned")
    parts = [
        one(n, _name("nation", "n_nationkey"), _name("region", "n_regionkey"), "located_in", F.lit(1)),
        one(c, _name("customer", "c_custkey"), _name("nation", "c_nationkey"), "based_in", F.lit(1)),
        one(s, _name("supplier", "s_suppkey"), _name("nation", "s_nationkey"), "based_in", F.lit(1)),
        one(s, _name("supplier", "s_suppkey"), _name("nation", "s_nationkey"), None, F.lit(2)),
        one(o, _name("order", "o_orderkey"), _name("customer", "o_custkey"), "placed_by", F.lit(1)),
        one(li, _name("order", "l_orderkey"), _name("part", "l_partkey"), "contains", F.col("l_linenumber") + 1, returned),
        one(li.join(paged, "l_partkey", "left_semi"), _name("part", "l_partkey"), _name("supplier", "l_suppkey"), "supplied_by", F.col("l_linenumber")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PAGES = f"""pages_ AS (
    SELECT 'region:' || r_regionkey AS page, 'region/' || r_regionkey || '.md' AS path FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation/' || n_nationkey || '.md' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer/' || c_custkey || '.md' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier/' || s_suppkey || '.md' FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'order/' || o_orderkey || '.md' FROM orders
    UNION ALL SELECT 'part:' || p_partkey, 'part/' || p_partkey || '.md' FROM part WHERE p_size <= {PAGED})"""
EDGES = f"""edges_ AS (
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'located_in' AS predicate, CAST(NULL AS VARCHAR) AS annotation, 1 AS line FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'based_in', NULL, 1 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', NULL, 1 FROM supplier
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, NULL, NULL, 2 FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', NULL, 1 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CAST(l_linenumber + 1 AS INTEGER) FROM lineitem
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', NULL, CAST(l_linenumber AS INTEGER) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= {PAGED}))"""
GRAPH = f"{PAGES}, {EDGES}"

def days(spark: SparkSession, d: str) -> DataFrame:
    """(seq, page, target): the links of each day's snapshot: users as pages, kinds of events as targets."""
    e = read(spark, d, "events")
    return e.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("page"), F.col("event_type").alias("target")).distinct()


DAYS = "days_ AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS seq, 'user:' || user_id AS page, event_type AS target FROM events)"
