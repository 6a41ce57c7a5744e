"""Streams: a watched vault, first-seen items, exact rate limits, an operation log.

The batch operators do the work; a stream calls them for each trigger and keeps what it must remember in tables of the
shared folder or in state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import graph
from ..scratch import scratch_root, table

#: The least and most time that changes are gathered, in ms, and the usual one.
DEBOUNCE = (10, 5000, 150)


def graph_events(old: tuple[DataFrame, DataFrame] | None, new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(event, page, target) between two graphs (edges, pages); the first graph is all additions."""
    edges, pages = new
    before = old or (edges.limit(0), pages.limit(0))
    diff = graph.graph_diff(*before, edges, pages)
    return diff.select(F.col("change").alias("event"), F.col("a").alias("page"), F.col("b").alias("target"))


class Watch:
    """Pages that arrive as a stream of (path, seq, content), of which the newest of a path counts and null content removes.

    Each trigger merges its pages into the table, skips those whose text is unchanged, builds the graph and hands the
    events, then one `index_updated`, to the sink. Pages and graph are tables in `state`, a folder for each epoch, whose
    last file is written last: a restarted driver goes on from the newest whole epoch, and an epoch that is run again
    starts from the one before it, so it gives the same events.
    """

    def __init__(self, spark: SparkSession, to_graph: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame, int], None], state: str | None = None):
        self.spark, self.to_graph, self.sink = spark, to_graph, sink
        self.state = state or f"{scratch_root(spark)}/watch-{uuid.uuid4().hex[:12]}"

    def _before(self, epoch: int) -> str | None:
        """The folder of the newest whole epoch before this one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [p.getPath().getName() for p in fs.listStatus(root)] if fs.exists(root) else []
        done = [e for e in (int(x[6:]) for x in found if x.startswith("epoch-")) if e < epoch and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/epoch-{e}/nodes/_SUCCESS"))]
        return f"{self.state}/epoch-{max(done)}" if done else None

    @property
    def pages(self) -> DataFrame | None:
        at = self._before(1 << 62)
        return self.spark.read.parquet(f"{at}/pages") if at else None

    def batch(self, df: DataFrame, epoch: int) -> None:
        newest = Window.partitionBy("path").orderBy(F.desc("seq"))
        got = table(df.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").select("path", "content"), "arrived")
        at, here = self._before(epoch), f"{self.state}/epoch-{epoch}"
        known = self.spark.read.parquet(f"{at}/pages") if at else None
        if known is not None:
            same = known.select("path", F.sha2("content", 256).alias("_h"))
            got = table(got.join(same, "path", "left").filter(~F.sha2("content", 256).eqNullSafe(F.col("_h"))).select("path", "content"), "changed")
        if got.isEmpty():
            return
        kept = got.filter("content is not null")
        if known is not None:
            kept = known.join(got.select("path"), "path", "left_anti").unionByName(kept)
        old = (self.spark.read.parquet(f"{at}/edges"), self.spark.read.parquet(f"{at}/nodes")) if at else None
        now = []
        for name, make in (("pages", lambda: kept), ("edges", lambda: self.to_graph(now[0])[0]), ("nodes", lambda: self.to_graph(now[0])[1])):
            make().write.mode("overwrite").parquet(f"{here}/{name}")
            now.append(self.spark.read.parquet(f"{here}/{name}"))
        events = graph_events(old, (now[1], now[2]))
        done = self.spark.createDataFrame([("index_updated", None, None)], "event string, page string, target string")
        self.sink(events.unionByName(done), epoch)

    def start(self, stream: DataFrame, debounce_ms: int = DEBOUNCE[2], checkpoint: str | None = None) -> StreamingQuery:
        wait = min(DEBOUNCE[1], max(DEBOUNCE[0], debounce_ms))
        writer = stream.writeStream.foreachBatch(self.batch).trigger(processingTime=f"{wait} milliseconds")
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def reconcile(served: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action) of files(path, content) edited outside against served(path, content): reload, drop, or nothing for equal texts."""
    both = files.select("path", F.sha2("content", 256).alias("_f")).join(served.select("path", F.sha2("content", 256).alias("_s")), "path", "full")
    action = F.when(F.col("_f").isNull(), "drop").when(~F.col("_f").eqNullSafe(F.col("_s")), "reload")
    return both.select("path", action.alias("action")).filter("action is not null")


def first_seen(items: DataFrame, known_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that appends items(guid, link, hash, ...) which no signal has shown before to a table of all seen.

    An epoch that is run again replaces its own rows and sees those of the others only. Each batch reads the whole table;
    seen.FirstSeen reads what its signals ask for.
    """
    from .seen import SIGNALS, new_items

    spark = items.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        try:
            known = spark.read.schema("guid string, link string, hash string, epoch long").parquet(known_path).filter(F.col("epoch") != epoch)
        except Exception as e:  # there is no table before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "guid string, link string, hash string")
        lent = known.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in SIGNALS))).alias("s")).select("s.*").filter("value <> ''")
        new = table(new_items(df, lent).select("guid", "link", "hash"), "new")
        new.write.mode("overwrite").parquet(f"{known_path.rstrip('/')}/epoch={epoch}")

    return batch


def allow(times: list[float], kept: list[float], window: float, most: int) -> tuple[list[bool], list[float]]:
    """Decisions for hits in the order of time, and the hits that still count: a denied one isn't recorded."""
    out = []
    for t in times:
        kept = [k for k in kept if k > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


LIMITED = "key string, t double, allowed boolean"


def rate_limit(hits: DataFrame, window: float, most: int) -> DataFrame:
    """(key, t, allowed) of hits(key, t) by an exact sliding window for each key.

    The rule depends on its own decisions, so a key is read in order. A batch keeps at most `most` times of a key.
    """

    def sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for b in batches:
            ok = []
            for k, t in zip(b["key"], b["t"], strict=True):
                if k != now:
                    now, kept = k, []
                one, kept = allow([t], kept, window, most)
                ok += one
            yield pd.DataFrame({"key": b["key"], "t": b["t"], "allowed": ok})

    # keys in order, a key in the order of time: one pass, no key is held in memory
    return hits.select("key", F.col("t").cast("double").alias("t")).repartition("key").sortWithinPartitions("key", "t").mapInPandas(sorted_runs, LIMITED)


def rate_limit_stream(hits: DataFrame, window: float, most: int) -> DataFrame:
    """The same over a stream; state is a key's recorded times, and it ends when they all are old."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        b = pd.concat(list(batches)).sort_values("t")
        ok, kept = allow(b["t"].tolist(), kept, window, most)
        state.update((kept,))
        state.setTimeoutDuration(int(window * 1000))
        yield pd.DataFrame({"key": key[0], "t": b["t"].tolist(), "allowed": ok})

    return hits.select("key", F.col("t").cast("double").alias("t")).groupBy("key").applyInPandasWithState(run, LIMITED, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hits_within(hits: DataFrame, window: float) -> DataFrame:
    """hits(key, t, ...) with `n`: how many of the key lie in the window that ends with each, itself included."""
    upto = Window.partitionBy("key").orderBy("t").rangeBetween(-window, 0)
    return hits.withColumn("n", F.count("*").over(upto))


def replay(ops: DataFrame) -> DataFrame:
    """(slug, content, seq) from a log of ops(slug, seq, content, truncate): the last content after the last truncation."""
    cut = ops.groupBy("slug").agg(F.max(F.when(F.col("truncate"), F.col("seq"))).alias("_cut"))
    live = ops.join(cut, "slug").filter("not truncate and (_cut is null or seq > _cut)")
    return live.groupBy("slug").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def append_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """new(ts, vault_root_hash) unless the newest snapshot has that hash already."""
    last = snapshots.agg(F.max_by("vault_root_hash", "ts").alias("vault_root_hash"))
    return new.join(last, "vault_root_hash", "left_anti")
