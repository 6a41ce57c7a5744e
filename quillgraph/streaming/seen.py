"""First-seen items: an item is new if no new item before it has one of its signals.

Only new items lend their signals, so whether one is new depends on those before it. Rounds decide: an item that is the
first of all open ones in each of its signals is new, and open items that share a signal with it are not. Items are
numbered by their order and taken in stretches, each some times as long as all before it: what shares a signal with a new
item of earlier stretches never enters rounds. What was seen in earlier batches is kept by signal in buckets, of which a
batch reads and writes those that its own signals lie in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import table
from .buckets import Buckets, bucket, touched

SIGNALS = ("guid", "link", "hash")
KEY = ["kind", "value"]


#: Items of the first stretch, and how many times as long as all before it the next one is.
STRETCH, TIMES = 200_000, 3

#: So many open signals are one task's work, whatever the stretch had: the longest chains have few items left.
GATHERED = 100_000


def ordered(items: DataFrame) -> DataFrame:
    """items with _id, which grows by seq, then by signals; of rows equal in these any one is first. Written in that order."""
    order = ["seq", *SIGNALS, "_tie"]  # without ties copies of one item would all be one range
    ranged = items.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return table(ranged.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "items")


def signals(items: DataFrame) -> DataFrame:
    """(_id, kind, value) of items(_id, guid, link, hash): a row for each signal that isn't empty or null."""
    each = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in SIGNALS))
    return items.select("_id", F.explode(each).alias("s")).select("_id", "s.*").filter("value <> ''")


def mute() -> Column:
    """Whether an item has no signal."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in SIGNALS)).isNull()


def decide(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """The _id of the items that are new among ordered() rows, when known(kind, value) were lent before; and the rounds it took.

    A round decides every item of a stretch whose earlier sharers are decided, so rounds are as many as the longest chain
    of items in which each depends on the one before; copies of one item need one. The last GATHERED open signals of a
    stretch are decided one by one in a task, as those rounds would.
    """
    narrow = rows.select("_id", *SIGNALS).filter(~mute())
    lent, new, rounds = known.select(*KEY), rows.select("_id").limit(0), 0
    for lo, hi in _stretches(narrow, known.count()):
        left = table(signals(_unlent(narrow.filter(F.col("_id").between(lo, hi)), lent)), "open")
        while n := left.count():
            if n <= GATHERED:
                gives = table(left.coalesce(1).sortWithinPartitions("_id").mapInArrow(_one_by_one, "_id long, kind string, value string, round int"), "lent")
                lent, new, rounds = lent.unionByName(gives.select(*KEY)), new.union(gives.select("_id").distinct()), rounds + gives.agg(F.max("round")).first()[0]
                break
            firsts = left.groupBy(*KEY).agg(F.min("_id").alias("_first"))
            own = left.join(firsts, KEY).groupBy("_id").agg(F.bool_and(F.col("_first") == F.col("_id")).alias("all"), F.collect_list(F.struct(*KEY)).alias("s"))
            won = table(own.filter("all").select("_id", "s"), "won")
            gives = table(won.select(F.explode("s").alias("s")).select("s.*").distinct(), "lent")
            out = left.join(gives, KEY, "left_semi").select("_id").distinct()
            left, lent, new, rounds = table(left.join(out, "_id", "left_anti"), "open"), lent.unionByName(gives), new.union(won.select("_id")), rounds + 1
    return new, rounds


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of signals by _id, those that new items lend, and the round that would have decided it: each item after the ones before it."""
    lent, gone, won, now, own = {}, {}, [], None, []
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for i, *signal in chain(rows, [(None, None, None)]):
        if i != now:
            if own and (met := [lent[s] for s in own if s in lent]):
                gone |= {s: max(gone.get(s, 0), min(met)) for s in own}
            elif own:
                at = 1 + max(gone.get(s, 0) for s in own)
                lent |= dict.fromkeys(own, at)
                won += [(now, *s, at) for s in own]
            now, own = i, []
        own.append(tuple(signal))
    if won:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*won), (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["_id", *KEY, "round"])


def _unlent(items: DataFrame, lent: DataFrame) -> DataFrame:
    """The items none of whose signals was lent, kind by kind: what one kind takes away isn't moved for the next."""
    for c in SIGNALS:
        items = items.join(lent.filter(F.col("kind") == c).select(F.col("value").alias(c)), c, "left_anti")
    return items


def _stretches(items: DataFrame, lent: int) -> list[tuple[int, int]]:
    """The first and last _id of stretches of items, when so many signals were lent before: a few, as each is TIMES all before."""
    ends = items.agg(F.count("*").alias("n"), F.max("_id").alias("last")).first()
    upto, cuts = max(STRETCH, TIMES * (lent // len(SIGNALS))), []
    while upto < ends["n"]:
        cuts.append(upto / ends["n"])
        upto *= 1 + TIMES
    at = sorted({*(items.agg(F.percentile_approx("_id", cuts)).first()[0] if cuts else []), ends["last"]}) if ends["n"] else []
    return [(lo + 1, hi) for lo, hi in zip([-1, *at], at)]


def new_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of items(seq, guid, link, hash, ...) that are new after known(kind, value). Items without a signal all are.

    Items come by seq, then by their signals; of rows equal in all of these any one is the first.
    """
    return _fresh(ordered(items), known)[0].drop("_id")


def _fresh(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    new, rounds = decide(rows, known)
    return table(rows.filter(mute()).unionByName(rows.join(table(new, "new"), "_id", "left_semi")), "fresh"), rounds


class FirstSeen:
    """A foreachBatch that hands the new items of each batch to emit(items, epoch), with what it has seen below `root`.

    keep: signals lent by an item whose seq is more than this below the smallest of a batch are forgotten; null keeps
    all. An epoch that is done again begins from the state before it and emits the same items, so emit() should put
    them under the epoch's number.
    """

    def __init__(self, spark: SparkSession, root: str, emit: Callable[[DataFrame, int], None], n: int = 64, keep: int | None = None):
        self.emit, self.keep = emit, keep
        self.buckets = Buckets(spark, root, {"signals": "kind string, value string, at long"}, n)

    def __call__(self, items: DataFrame, epoch: int) -> None:
        b = self.buckets
        b.begin(epoch)
        rows = ordered(items)
        which = touched(signals(rows), b.n, *KEY)
        known = b.read("signals", which)
        if self.keep is not None:
            least = rows.agg(F.min("seq")).first()[0]
            known = known.filter(F.col("at") >= (least or 0) - self.keep)
        known = table(known, "known")
        fresh, self.rounds = _fresh(rows, known)
        self.emit(fresh.drop("_id"), epoch)
        lent = signals(fresh).join(fresh.select("_id", F.col("seq").cast("long").alias("at")), "_id").select(*KEY, "at")
        b.write("signals", known.unionByName(lent).groupBy(*KEY).agg(F.max("at").alias("at")), bucket(b.n, *KEY), which)
        b.commit()
