"""A tree of hashes over the files of a vault, which tells where two states differ and follows changes.

A file's node is the SHA-256 of its path; node `x` of level k holds the files whose node begins with its k digits. So
leaves fill evenly, whatever the paths, and a change touches one node of each level. Trees are rows (level, node, hash,
files, path): levels 0 to depth, and the files themselves one level below. Two trees of one depth are equal where
their hashes are, so comparing them descends only where they aren't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import table

#: Files of a leaf, about.
FILL = 64
#: Up to so many differing nodes the next level is asked for their ranges, which prunes sorted files; beyond, it is joined.
RANGES = 256

COLUMNS = ["level", "node", "hash", "files", "path"]


def depth_for(files: int) -> int:
    """Levels below the root so that leaves have about FILL files. States to be compared need the same."""
    depth = 0
    while files > FILL * 16**depth:
        depth += 1
    return depth


def _files(roots: DataFrame, depth: int) -> DataFrame:
    known = roots.filter("path is not null and root_hash is not null").groupBy("path").agg(F.min("root_hash").alias("root_hash"))
    return known.select(F.lit(depth + 1).alias("level"), F.sha2("path", 256).alias("node"), F.sha2(F.concat_ws("\n", "path", "root_hash"), 256).alias("hash"), F.lit(1).cast("long").alias("files"), "path")


def _parents(children: DataFrame, level: int) -> DataFrame:
    """The nodes above; each has 16 children, a leaf about FILL."""
    own = children.groupBy(F.substring("node", 1, level).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("x"), F.sum("files").alias("files"))
    text = F.concat_ws("\n", F.transform("x", lambda c: F.concat_ws(":", c["node"], c["hash"])))
    return own.select(F.lit(level).alias("level"), "node", F.sha2(text, 256).alias("hash"), "files", F.lit(None).cast("string").alias("path"))


def tree(roots: DataFrame, depth: int) -> DataFrame:
    """The tree of roots(path, root_hash). Rows without a path or hash are no files; of several hashes of a path the smallest counts."""
    levels = [table(_files(roots, depth), "files")]
    for k in range(depth, -1, -1):
        levels.append(table(_parents(levels[-1], k), "nodes"))
    return reduce(DataFrame.unionByName, levels)


def stored(found: DataFrame, path: str) -> DataFrame:
    """Write a tree by level, sorted by node, and read it back: what compare() asks for is then a range of its files."""
    found.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").partitionBy("level").parquet(path)
    return found.sparkSession.read.schema("node string, hash string, files long, path string, level int").parquet(path).select(*COLUMNS)


def rebuilt(old: DataFrame, changes: DataFrame, depth: int) -> DataFrame:
    """The tree after changes(path, root_hash); a null hash is a file that went. Only nodes above changed paths are hashed again."""
    known = changes.filter("path is not null")
    touched = table(known.select(F.sha2("path", 256).alias("node")).distinct(), "touched")
    fresh = table(_files(known, depth), "fresh")
    made, gone = [fresh], [touched.withColumn("level", F.lit(depth + 1))]
    for k in range(depth, -1, -1):
        above = table(touched.select(F.substring("node", 1, k).alias("node")).distinct(), "touched")
        parent = F.substring("node", 1, k)
        siblings = old.filter(F.col("level") == k + 1).join(touched, "node", "left_anti").withColumn("_up", parent).join(above.withColumnRenamed("node", "_up"), "_up", "left_semi")
        fresh, touched = table(_parents(siblings.select(*COLUMNS).unionByName(fresh), k), "fresh"), above
        made.append(fresh)
        gone.append(touched.withColumn("level", F.lit(k)))
    kept = old.join(reduce(DataFrame.unionByName, gone), ["level", "node"], "left_anti").select(*COLUMNS)
    return reduce(DataFrame.unionByName, made, kept)


def _below(nodes: list[str]) -> Column:
    """Nodes that begin with one of these; 'g' is behind all digits."""
    ranges = [(F.col("node") >= n) & (F.col("node") < n + "g") for n in nodes]
    while len(ranges) > 1:
        ranges = [reduce(Column.__or__, ranges[i : i + 2]) for i in range(0, len(ranges), 2)]
    return ranges[0]


def compare(old: DataFrame, new: DataFrame, depth: int, figures: dict[int, int] | None = None) -> DataFrame:
    """(path, change) of the files that differ: added, removed, modified. figures gets how many nodes of each level were compared."""
    differs, names = None, []
    for k in range(depth + 2):
        a, b = (t.filter(F.col("level") == k) for t in (old, new))
        if differs is not None:
            up = F.substring("node", 1, k - 1)
            if len(names) <= RANGES:
                a, b = a.filter(_below(names)), b.filter(_below(names))
            else:
                a, b = (t.withColumn("_up", up).join(differs.select(F.col("node").alias("_up")), "_up", "left_semi") for t in (a, b))
        was = a.select("node", F.col("hash").alias("_a"), F.col("path").alias("_pa"))
        now = b.select("node", F.col("hash").alias("_b"), F.col("path").alias("_pb"))
        seen = Observation()
        met = was.join(now, "node", "full").observe(seen, F.count(F.lit(1)).alias("n"))
        differs = table(met.filter(~F.col("_a").eqNullSafe(F.col("_b"))), "differs")
        if figures is not None:
            figures[k] = seen.get["n"]
        names = [r[0] for r in differs.select("node").limit(RANGES + 1).collect()]
        if not names:
            break
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    return differs.select(F.coalesce("_pa", "_pb").alias("path"), kind.alias("change"))
