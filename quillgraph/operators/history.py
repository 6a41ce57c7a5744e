"""Snapshots of a link graph over time: deltas, collapsing, page histories, changes, trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..scratch import table


def resolve_snapshot(snapshots: DataFrame, expression: str, now: datetime) -> DataFrame:
    """The row of snapshots(change_id, ts, ...) that a time expression means, or none.

    A time: the newest at or before it. HEAD~n: the n-th before the newest. Else a change id's beginning.
    """
    kind, value = dates.parse_time(expression, now)
    order = [F.desc("ts"), F.desc("change_id")]
    if kind == "at":
        return snapshots.filter(F.col("ts") <= F.lit(value)).orderBy(*order).limit(1)
    if kind == "offset":
        return snapshots.orderBy(*order).offset(value).limit(1)
    hits = snapshots.filter(F.col("change_id").startswith(value)).limit(2)
    return hits.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).filter("_n = 1").drop("_n")


def as_of(times: DataFrame, snapshots: DataFrame, by: str | None = None) -> DataFrame:
    """times(ts, ...) each with the change_id of the newest snapshot at or before it, by key if there is one.

    Without a key, time is cut into ranges: each finds its own, and the last snapshot of the ranges before is carried over.
    """
    keys = [by] if by else []
    left = times.select(*keys, "ts", F.struct(*[c for c in times.columns if c not in (*keys, "ts")]).alias("_t"), F.lit(None).cast("string").alias("_c"))
    right = snapshots.select(*keys, "ts", F.lit(None).cast(left.schema["_t"].dataType).alias("_t"), F.col("change_id").alias("_c"))
    both, order = left.unionByName(right), ["ts", F.col("_t").isNotNull(), "_c"]
    if by:
        upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("change_id", F.last("_c", ignorenulls=True).over(upto))
    else:
        ranged = table(both.repartitionByRange("ts").withColumn("_p", F.spark_partition_id()), "ranged")
        lasts = ranged.groupBy("_p").agg(F.max(F.when(F.col("_c").isNotNull(), F.struct("ts", "_c")))["_c"].alias("_last"))
        carry = lasts.select("_p", F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
        upto = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # carry has a row for each range
        found = ranged.withColumn("_own", F.last("_c", ignorenulls=True).over(upto)).join(F.broadcast(carry), "_p").withColumn("change_id", F.coalesce("_own", "_carry"))
    return found.filter("_t is not null").select(*keys, "ts", "_t.*", "change_id")


def tree_at(files: DataFrame, change: str) -> DataFrame:
    """(path, content) of every file as of a change, from files(seq, change_id, path, content), which holds what each change wrote.

    A null content is a deletion. Of each path the newest version up to the change counts.
    """
    upto = files.filter(F.col("change_id") == change).agg(F.max("seq").alias("_upto"))
    newest = files.join(F.broadcast(upto), F.col("seq") <= F.col("_upto")).groupBy("path").agg(F.max_by(F.struct("content"), "seq").alias("f"))
    return newest.select("path", "f.content").filter("content is not null")


def file_at(files: DataFrame, change: str, path: str) -> DataFrame:
    """The row of tree_at() for one path; that filter reaches the scan."""
    return tree_at(files.filter((F.col("path") == path) | (F.col("change_id") == change)), change).filter(F.col("path") == path)


def changed_names(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, change) of the files that differ between two changes: added, removed, modified."""
    was = tree_at(files, old).select("path", F.sha2("content", 256).alias("_o"))
    now = tree_at(files, new).select("path", F.sha2("content", 256).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified")
    return now.join(was, "path", "full").select("path", kind.alias("change")).filter("change is not null")


def collapse(timeline: DataFrame) -> DataFrame:
    """timeline(ts, vault_root_hash, ...) with the newest of each hash; rows without one all stay."""
    newest = Window.partitionBy("vault_root_hash").orderBy(F.desc("ts"))
    told = timeline.filter("vault_root_hash is not null").withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
    return told.unionByName(timeline.filter("vault_root_hash is null"))


def since(timeline: DataFrame, kind: str, value) -> DataFrame:
    """timeline(ts, change_id) cut at a time, after n + 1 rows, or with the first change whose id begins so."""
    if kind == "at":
        return timeline.filter(F.col("ts") >= F.lit(value))
    if kind == "offset":
        return timeline.orderBy(F.desc("ts")).limit(value + 1)
    first = timeline.filter(F.col("change_id").startswith(value)).agg(F.max("ts").alias("_from"))
    return timeline.join(F.broadcast(first), F.col("ts") >= F.col("_from"), "left_semi")


def vault_history(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each of snapshots(seq) with totals and what changed since the one before.

    links(seq, page, target) hold a snapshot's pages and links; a null target is a page without links. Pages count as
    sets; links by their number, so links_added is the net gain and links_removed the net loss.
    """
    pages = links.select("seq", "page").distinct()
    totals = links.groupBy("seq").agg(F.count_distinct("page").alias("total_pages"), F.count("target").alias("total_links"))
    order = Window.orderBy("seq")
    base = snapshots.select("seq").distinct().join(totals, "seq", "left").na.fill(0, ["total_pages", "total_links"]).withColumn("before", F.lag("seq").over(order)).withColumn("links_before", F.lag("total_links").over(order))
    nxt = base.select("seq", "before").filter("before is not null")
    was = pages.withColumnRenamed("seq", "before").join(nxt, "before").select("seq", "page", F.lit(1).alias("was"))
    now = pages.join(nxt.select("seq"), "seq", "left_semi").select("seq", "page", F.lit(1).alias("now"))
    moved = now.join(was, ["seq", "page"], "full").groupBy("seq").agg(F.count_if(F.col("was").isNull()).alias("pages_added"), F.count_if(F.col("now").isNull()).alias("pages_removed"))
    gain = F.col("total_links") - F.coalesce("links_before", "total_links")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(moved, "seq", "left").select("seq", "total_pages", "total_links", zero("pages_added"), zero("pages_removed"), F.greatest(gain, F.lit(0)).alias("links_added"), F.greatest(-gain, F.lit(0)).alias("links_removed"))


def page_history(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """(page, seq, event, added, removed) where a page appears, disappears or changes its targets.

    A page's states are compared with their neighbours by the number of their snapshot(seq): a gap is a disappearance
    right after the earlier one and an appearance at the later one. So rows are the states there are, not pages times
    snapshots.
    """
    order = Window.orderBy("seq")
    ranks = snapshots.select("seq").distinct().withColumn("rank", F.row_number().over(order)).withColumn("next_seq", F.lead("seq").over(order))
    state = links.groupBy("page", "seq").agg(F.sort_array(F.collect_set("target")).alias("targets")).join(ranks, "seq")
    own = Window.partitionBy("page").orderBy("rank")
    near = state.withColumn("was", F.lag(F.struct("rank", "targets")).over(own)).withColumn("then", F.lead("rank").over(own))
    none = F.array().cast("array<string>")
    kept = F.coalesce(F.col("was.rank") == F.col("rank") - 1, F.lit(False))
    old = F.when(kept, F.col("was.targets")).otherwise(none)
    here = F.when(~kept, "appeared").when(F.col("was.targets") != F.col("targets"), "changed")
    gone = F.col("next_seq").isNotNull() & F.coalesce(F.col("then") > F.col("rank") + 1, F.lit(True))
    events = F.array(
        F.when(here.isNotNull(), F.struct("seq", here.alias("event"), F.array_except("targets", old).alias("added"), F.array_except(old, "targets").alias("removed"))),
        F.when(gone, F.struct(F.col("next_seq").alias("seq"), F.lit("disappeared").alias("event"), none.alias("added"), F.col("targets").alias("removed"))),
    )
    return near.select("page", F.explode(events).alias("e")).filter("e is not null").select("page", "e.*")


def recent_changes(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(seq, page, change) between neighbouring snapshots of files(seq, page, root_hash), newest first."""
    seqs = files.select("seq").distinct().withColumn("before", F.lag("seq").over(Window.orderBy("seq"))).filter("before is not null")
    now = files.join(seqs, "seq").select("seq", "page", F.col("root_hash").alias("h"))
    was = files.withColumnRenamed("seq", "before").join(seqs, "before").select("seq", "page", F.col("root_hash").alias("o"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("o") != F.col("h"), "modified")
    out = now.join(was, ["seq", "page"], "full").select("seq", "page", kind.alias("change")).filter("change is not null")
    out = out.orderBy(F.desc("seq"), "page")
    return out.limit(limit) if limit else out


def link_since(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """(page, target, since): when each link was first seen."""
    return links.join(snapshots.select("seq", "ts"), "seq").groupBy("page", "target").agg(F.min("ts").alias("since"))


def sample_trend(history: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of history(seq, ...), evenly spaced from the oldest to the newest."""
    if most <= 0:
        return history.limit(0)
    ranked = number(history, [F.col("seq")], "_at")
    n = ranked.count()
    at = sorted({j if n <= most else 0 if most == 1 else j * (n - 1) // (most - 1) for j in range(min(n, most))})
    return ranked.join(F.broadcast(history.sparkSession.createDataFrame([(i,) for i in at], "_at long")), "_at").drop("_at")


def page_ages(events: DataFrame, today: datetime) -> DataFrame:
    """(page, created, last_changed, age, stable) of events(page, ts): ages in days, in words."""
    span = events.groupBy("page").agg(F.min("ts").alias("created"), F.max("ts").alias("last_changed"))
    days = lambda c: F.datediff(F.lit(today), F.col(c))
    return span.select("page", "created", "last_changed", days("created").alias("age_days"), days("last_changed").alias("stable_days"), dates.humanise_days(days("created")).alias("age"))


def history_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("snapshots"), F.count_distinct("vault_root_hash").alias("distinct_hashes"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def object_changes(old: DataFrame, new: DataFrame, start: int = 0) -> DataFrame:
    """(seq, object_id, change, path) from old(object_id, path, hash) to new: added, moved, updated, deleted.

    A move wins over an update. Numbers run over new objects by id, then over deletions, from start.
    """
    o = old.select("object_id", F.col("path").alias("_p"), F.col("hash").alias("_h"), F.lit(1).alias("_o"))
    both = new.withColumn("_n", F.lit(1)).join(o, "object_id", "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("path") != F.col("_p"), "moved").when(F.col("hash") != F.col("_h"), "updated")
    out = both.select("object_id", kind.alias("change"), F.coalesce("path", "_p").alias("path")).filter("change is not null")
    return number(out, [F.col("change") == "deleted", F.col("object_id")], "seq", start)


def number(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Running numbers over the whole frame: rows of ranges, then an offset for each, so no task holds all."""
    return numbered(table(in_ranges(df, order), "numbered"), name, start)


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of an order, with marks from which numbered() counts once it is written."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())


def numbered(kept: DataFrame, name: str, start: int = 0) -> DataFrame:
    sums = kept.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.join(F.broadcast(sums.select("_p", "_off", "_first")), "_p").withColumn(name, F.col("_off") + F.col("_i") - F.col("_first") + start).drop("_p", "_i", "_off", "_first")
