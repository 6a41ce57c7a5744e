"""Tables in buckets, of which a change rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders that the driver lists by itself.
LISTED_HERE = 512


def bucket(n: int, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


class Buckets:
    """Versions of bucketed tables below `root`: `table/epoch-E/bucket=B`, and a manifest for each epoch.

    An epoch writes whole new versions of the buckets that it touches and then its manifest, which names the version of
    every bucket that has rows. Without its manifest an epoch hasn't happened: a restarted one begins from the manifest
    before it and writes over what it left. Versions that neither the newest manifest nor the one before it names are
    removed. The driver holds the manifest, a number for each bucket.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], n: int):
        self.spark, self.root, self.tables, self.n = spark, root.rstrip("/"), tables, n
        self.written = self.read_buckets = 0

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folders(self, path: str, prefix: str) -> list[int]:
        fs, where = self._fs(path)
        names = [p.getPath().getName() for p in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(x[len(prefix) :]) for x in names if x.startswith(prefix))

    def epochs(self) -> list[int]:
        """Those that have happened."""
        done = []
        for e in self._folders(f"{self.root}/manifest", "epoch-"):
            fs, mark = self._fs(f"{self.root}/manifest/epoch-{e}/_SUCCESS")
            if fs.exists(mark):
                done.append(e)
        return done

    def _manifest(self, epoch: int) -> dict[tuple[str, int], int]:
        rows = self.spark.read.schema("name string, bucket int, epoch long, buckets int").parquet(f"{self.root}/manifest/epoch-{epoch}").collect()
        if any(r["buckets"] != self.n or r["name"] not in self.tables for r in rows):
            raise ValueError(f"{self.root} has another number of buckets than {self.n}, or other tables")
        return {(r["name"], r["bucket"]): r["epoch"] for r in rows}

    def begin(self, epoch: int) -> None:
        """Work from the newest epoch before this one."""
        before = [e for e in self.epochs() if e < epoch]
        self.epoch, self.now = epoch, self._manifest(before[-1]) if before else {}
        self.written = self.read_buckets = 0

    def latest(self) -> Buckets:
        self.begin(1 << 62)
        return self

    def none(self, name: str) -> DataFrame:
        """No rows of a table, so that plans know it: what is joined with them isn't moved."""
        return self.spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in self.tables[name].split(", "))))

    def read(self, name: str, which: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets of a table, or of all, as they are now in this epoch."""
        which = range(self.n) if which is None else which
        paths = [f"{self.root}/{name}/epoch-{self.now[name, b]}/bucket={b}" for b in which if (name, b) in self.now]
        self.read_buckets += len(paths)
        if not paths:
            return self.none(name)
        # the folders hold a file each: up to some hundreds are listed faster here than by a job
        key, most = "spark.sql.sources.parallelPartitionDiscovery.threshold", self.spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold")
        self.spark.conf.set(key, str(max(int(most), LISTED_HERE)))
        try:
            return self.spark.read.schema(self.tables[name]).parquet(*paths)
        finally:
            self.spark.conf.set(key, most)

    def write(self, name: str, rows: DataFrame, by: Column, which: list[int]) -> None:
        """Replace some buckets of a table by rows, all of which lie in them. A large bucket is several tasks' and files."""
        if not which:
            return
        seen, path = Observation(), f"{self.root}/{name}/epoch-{self.epoch}"
        own = rows.select(*(c.split()[0] for c in self.tables[name].split(", "))).withColumn("bucket", by)
        own.hint("rebalance", F.col("bucket")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        self.written += seen.get["n"]
        full = set(self._folders(path, "bucket="))
        for b in which:
            self.now.pop((name, b), None)
            if b in full:
                self.now[name, b] = self.epoch

    def commit(self) -> None:
        rows = [(n, b, e, self.n) for (n, b), e in sorted(self.now.items())]
        self.spark.createDataFrame(rows, "name string, bucket int, epoch long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/epoch-{self.epoch}")
        self._clean()

    def _clean(self) -> None:
        old = [e for e in self.epochs() if e <= self.epoch]
        kept = {(n, b, e) for k in old[-2:] for (n, b), e in self._manifest(k).items()}
        for name in self.tables:
            for e in self._folders(f"{self.root}/{name}", "epoch-"):
                if e > self.epoch:
                    continue
                used = {b for n, b, x in kept if n == name and x == e}
                gone = [f"{self.root}/{name}/epoch-{e}"] if not used else [f"{self.root}/{name}/epoch-{e}/bucket={b}" for b in self._folders(f"{self.root}/{name}/epoch-{e}", "bucket=") if b not in used]
                for path in gone:
                    fs, where = self._fs(path)
                    fs.delete(where, True)
        for e in old[:-2]:
            fs, where = self._fs(f"{self.root}/manifest/epoch-{e}")
            fs.delete(where, True)


def touched(rows: DataFrame, n: int, *by: Column | str) -> list[int]:
    """The buckets that rows lie in: at most n numbers."""
    return sorted(r[0] for r in rows.select(bucket(n, *by)).distinct().collect())
