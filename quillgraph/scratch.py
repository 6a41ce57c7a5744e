"""Tables written between the steps of a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and executors are in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def table(df: DataFrame, name: str, seen: Observation | None = None, *figures: Column) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    seen gets the figures, aggregates of df, without another pass. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.observe(seen, *figures) if seen else df).write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
