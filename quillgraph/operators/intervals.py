"""A history as intervals: what held from one snapshot until another, instead of a row for each snapshot it held at.

Spans are (*keys, since, until): `since` is the first snapshot of an unbroken run, `until` the first one that lacks it,
null while it holds. A history that changes little is as large as its changes. Links become spans of (page, target,
copies); a page itself is a span with a null target and no copies. Rows without a snapshot number or a page are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_root, table
from .history import number

LINK = ["page", "target", "copies"]


def spans(snapshots: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, since, until) of states(seq, *keys) at snapshots(seq), which may hold snapshots without any state.

    A key's rank among snapshots less its rank among its own rows is the same all through a run.
    """
    known = snapshots.select("seq").filter("seq is not null").distinct()
    ranks = table(number(known, [F.col("seq")], "_rank"), "ranks")
    held = states.select("seq", *keys).distinct().join(ranks, "seq")
    own = Window.partitionBy(*keys).orderBy("_rank")
    runs = held.withColumn("_run", F.col("_rank") - F.row_number().over(own)).groupBy(*keys, "_run").agg(F.min("seq").alias("since"), F.max("_rank").alias("_last"))
    after = ranks.select((F.col("_rank") - 1).alias("_last"), F.col("seq").alias("until"))
    return runs.join(after, "_last", "left").select(*keys, "since", "until")


def link_states(links: DataFrame) -> DataFrame:
    """(seq, page, target, copies) of links(seq, page, target): each link with its number, and each page."""
    known = links.filter("page is not null")
    pages = known.select("seq", "page", F.lit(None).cast("string").alias("target"), F.lit(0).cast("long").alias("copies")).distinct()
    return known.filter("target is not null").groupBy("seq", "page", "target").agg(F.count("*").alias("copies")).unionByName(pages)


def link_spans(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    return spans(snapshots, link_states(links), LINK)


def version_spans(files: DataFrame) -> DataFrame:
    """(path, content, since, until) of files(seq, path, content), which hold what was written; a null content is a deletion.

    Neighbours are found on numbers alone and contents join after, so no task sorts the contents of a path that is
    written often. A path is written once in a snapshot; more contents of one are all given.
    """
    own = Window.partitionBy("path").orderBy("seq")
    times = files.select("path", "seq").distinct().withColumn("until", F.lead("seq").over(own))
    return files.filter("content is not null").join(times, ["path", "seq"]).select("path", "content", F.col("seq").alias("since"), "until")


def at(held: DataFrame, seq: int) -> DataFrame:
    """The spans that hold at a snapshot."""
    return held.filter((F.col("since") <= seq) & (F.col("until").isNull() | (F.col("until") > seq)))


def ends(held: DataFrame) -> DataFrame:
    """(..., seq, came): both ends of each span as events."""
    both = F.array(F.struct(F.col("since").alias("seq"), F.lit(True).alias("came")), F.struct(F.col("until").alias("seq"), F.lit(False).alias("came")))
    rest = [c for c in held.columns if c not in ("since", "until")]
    return held.select(*rest, F.explode(both).alias("_e")).select(*rest, "_e.*").filter("seq is not null")


def vault_history(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """history.vault_history() over link spans: sums of what came and went, running over a row for each snapshot."""
    sign = F.when(F.col("came"), 1).otherwise(-1)
    page = F.col("target").isNull()
    moves = ends(links).groupBy("seq").agg(F.count_if(page & F.col("came")).alias("pages_in"), F.count_if(page & ~F.col("came")).alias("pages_out"), F.sum(sign * F.col("copies")).alias("gain"))
    base = snapshots.select("seq").filter("seq is not null").distinct().join(moves, "seq", "left").na.fill(0, ["pages_in", "pages_out", "gain"])
    order = Window.orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    later = F.lag("seq").over(order).isNotNull()
    told = base.withColumn("total_pages", F.sum(F.col("pages_in") - F.col("pages_out")).over(upto)).withColumn("total_links", F.sum("gain").over(upto)).withColumn("later", later)
    from_second = lambda c: F.when(F.col("later"), c).otherwise(F.lit(0))
    return told.select(
        "seq", "total_pages", "total_links", from_second(F.col("pages_in")).alias("pages_added"), from_second(F.col("pages_out")).alias("pages_removed"),
        from_second(F.greatest("gain", F.lit(0))).alias("links_added"), from_second(F.greatest(-F.col("gain"), F.lit(0))).alias("links_removed"),
    )


def page_history(links: DataFrame) -> DataFrame:
    """history.page_history() over link spans: a target whose copies alone changed came and went at once, which is no event."""
    each = ends(links).groupBy("page", "target", "seq").agg(F.bool_or("came").alias("came"), F.bool_or(~F.col("came")).alias("went"))
    moved = each.filter("came <> went")
    page, names = F.col("target").isNull(), lambda c: F.sort_array(F.collect_list(F.when(F.col("target").isNotNull() & F.col(c), F.col("target"))))
    told = moved.groupBy("page", "seq").agg(F.bool_or(page & F.col("came")).alias("born"), F.bool_or(page & F.col("went")).alias("gone"), names("came").alias("added"), names("went").alias("removed"))
    event = F.when(F.col("born"), "appeared").when(F.col("gone"), "disappeared").otherwise("changed")
    return told.select("page", "seq", event.alias("event"), "added", "removed")


def recent_changes(snapshots: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """history.recent_changes() over spans of (page, root_hash): what changed after the first snapshot, newest first."""
    first = snapshots.agg(F.min("seq").alias("_first"))
    told = ends(files).join(F.broadcast(first), F.col("seq") > F.col("_first")).groupBy("seq", "page").agg(F.bool_or("came").alias("came"), F.bool_or(~F.col("came")).alias("went"))
    kind = F.when(~F.col("went"), "added").when(~F.col("came"), "removed").otherwise("modified")
    out = told.select("seq", "page", kind.alias("change")).orderBy(F.desc("seq"), "page")
    return out.limit(limit) if limit else out


class History:
    """Spans kept below `root`: `ended/until=S` with those that ended at S, and `open/at=S` with those that hold at S.

    What has ended is never read or written again by an append; a question about a time reads the folders of spans that
    ended later, and what is open. An append has happened once its open folder is complete: one that was cut off is
    done again from the state before it and writes over what it left. Two open states are kept, so the newest append
    can be done again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: str):
        """keys: names and types, as in a schema string; `since` and `until` are longs."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), keys
        self.keys = [k.split()[0] for k in keys.split(", ")]

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def appended(self) -> list[int]:
        """Snapshots whose state is open and complete, at most two or three."""
        fs, where = self._fs(f"{self.root}/open")
        names = [p.getPath().getName() for p in fs.listStatus(where)] if fs.exists(where) else []
        done = [int(n[3:]) for n in names if n.startswith("at=")]
        return sorted(s for s in done if fs.exists(self._fs(f"{self.root}/open/at={s}/_SUCCESS")[1]))

    def _open(self, seq: int | None) -> DataFrame:
        told = f"{self.schema}, since long"
        return self.spark.createDataFrame([], told) if seq is None else self.spark.read.schema(told).parquet(f"{self.root}/open/at={seq}")

    def _ended(self) -> DataFrame:
        told = f"{self.schema}, since long, until long"
        fs, where = self._fs(f"{self.root}/ended")
        return self.spark.read.schema(told).parquet(f"{self.root}/ended") if fs.exists(where) else self.spark.createDataFrame([], told)

    def load(self, held: DataFrame, newest: int) -> None:
        """Begin with the spans of all snapshots up to the newest."""
        kept = table(held.select(*self.keys, F.col("since").cast("long").alias("since"), F.col("until").cast("long").alias("until")), "spans")
        kept.filter("until is not null").hint("rebalance", "until").write.mode("overwrite").partitionBy("until").parquet(f"{self.root}/ended")
        kept.filter("until is null").drop("until").write.mode("overwrite").parquet(f"{self.root}/open/at={newest}")

    def append(self, seq: int, state: DataFrame) -> None:
        """The state(*keys) at a snapshot after all others; nulls among keys are equal, repeated rows are one.

        Old and new state meet in one grouped aggregate.
        """
        done = self.appended()
        if done and seq < done[-1]:
            raise ValueError(f"snapshot {seq} comes before {done[-1]}")
        before = [s for s in done if s < seq]
        old = self._open(before[-1] if before else None).select(*self.keys, "since", F.lit(True).alias("_was"), F.lit(False).alias("_is"))
        new = state.select(*self.keys, F.lit(None).cast("long").alias("since"), F.lit(False).alias("_was"), F.lit(True).alias("_is"))
        met = table(old.union(new).groupBy(*self.keys).agg(F.min("since").alias("since"), F.bool_or("_is").alias("_is")), "met")
        met.filter("not _is").drop("_is").write.mode("overwrite").parquet(f"{self.root}/ended/until={seq}")
        met.filter("_is").select(*self.keys, F.coalesce("since", F.lit(seq).cast("long")).alias("since")).write.mode("overwrite").parquet(f"{self.root}/open/at={seq}")
        for s in before[:-1]:
            fs, where = self._fs(f"{self.root}/open/at={s}")
            fs.delete(where, True)

    def spans(self, after: int | None = None) -> DataFrame:
        """All spans, or those that hold or end after a snapshot: folders of earlier ends aren't read."""
        newest = self.appended()[-1:]
        if not newest:
            return self._ended().limit(0)
        ended = self._ended().filter(F.col("until") <= newest[0])
        if after is not None:
            ended = ended.filter(F.col("until") > after)
        return ended.unionByName(self._open(newest[0]).withColumn("until", F.lit(None).cast("long")))

    def at(self, seq: int) -> DataFrame:
        """(*keys, since, until) of what held at a snapshot up to the newest."""
        return at(self.spans(after=seq), seq)

    def between(self, first: int, last: int) -> DataFrame:
        """(*keys, seq, came): what came and went after one snapshot up to another."""
        return ends(self.spans(after=first)).filter((F.col("seq") > first) & (F.col("seq") <= last))


def kept(spark: SparkSession, keys: str) -> History:
    """A history in the scratch folder."""
    import uuid

    return History(spark, f"{scratch_root(spark)}/history-{uuid.uuid4().hex[:12]}", keys)
