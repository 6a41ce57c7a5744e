"""Shards of nearly equal size by sampled splitters.

Rows have an order: a key from their text, so that equal texts stand together, then one from their id. A sample drawn
in proportion to size gives quantiles of the keys, and these cut the order into many ranges; a key that alone fills a
range gets a range of its own. The ranges' exact sizes are then counted, ranges that came out overfull are subdivided,
and prefix sums over the ranges give each row its place in the whole: shards are equal stretches of that order. Only
(key, id, size) of a row moves, ranges are small enough for one task each, and only ranges, never rows, meet in one
place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Rows that one range holds at about the mean, and the least and most number of ranges.
RANGE_ROWS, FEW, MANY = 250_000, 64, 1 << 16
#: Sampled keys a range.
DRAWS = 32


def _hash60(text: Column) -> Column:
    """60 bits of MD5, so that SQL elsewhere can give the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at most key: a binary search in an array."""
    steps, k = [], 1
    while k <= len(cuts):
        steps.insert(0, k)
        k *= 2
    if not cuts:
        return F.lit(0)
    bounds, n = F.array(*map(F.lit, cuts)) if len(cuts) < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>"), len(cuts)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(lo + s <= n, F.when(F.get(bounds, lo + s - 1) <= key, lo + s).otherwise(lo)).otherwise(lo))


def splitters(rows: DataFrame, n: int, total: int) -> list[int]:
    """About n - 1 keys that cut `rows` (key, tie, size) into ranges of equal size, from a size-weighted sample.

    A row is drawn with the probability that its size gives it; rows that would be drawn more than once count as often.
    The quantiles of the drawn keys are the cuts. A key that fills more than one range appears twice among them and
    then has a range of its own.
    """
    want = n * DRAWS
    chance = F.col("size") * F.lit(want / total)
    draw = (F.pmod(F.xxhash64("tie", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    times = (F.floor(chance) + F.when(F.col("u") < chance - F.floor(chance), 1).otherwise(0)).cast("int")
    drawn = rows.select("key", "size", draw).select("key", times.alias("times")).filter("times > 0")
    at = [i / n for i in range(1, n)]
    found = drawn.select(F.explode(F.array_repeat("key", F.col("times"))).alias("key")).agg(F.percentile_approx("key", at, max(10_000, 8 * n)).alias("q")).first()
    q = (found and found["q"]) or []
    cuts = set(q)
    cuts |= {b + 1 for a, b in zip(q, q[1:], strict=False) if a == b}
    return sorted(cuts)


def assign_shards(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): one row for each row of df.

    Law `bytes`: shards have nearly equal sums of size, the bytes of the text plus 1; two shards differ by less than
    the largest row's size, twice. A null text counts as empty. Equal texts stand together, in one shard unless a shard's
    end falls between them. slot is gapless from 0 in each shard. grown_shard is null: another number of shards moves
    rows. Rows that are equal in id and text are alike, so either may get either place. Null ids come with their text
    like others. An empty table gives an empty one; other columns of df don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = table(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            _hash60(text).alias("key"),
            _hash60(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("tie"),
        ),
        "rows",
    )
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    n_ranges = min(MANY, max(FEW, whole["n"] // RANGE_ROWS))
    cuts = splitters(rows, n_ranges, whole["total"]) if whole["n"] else []
    ranged = rows.withColumn("range", _range_of(F.col("key"), cuts))

    # overfull ranges are subdivided, in order: by tie where all have one key, else by key
    sums = ranged.groupBy("range").agg(F.sum("size").alias("sum"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    mean = max(1, whole["total"] // n_ranges)
    over = sums.filter(f"sum > {2 * mean}").select("range", "lo", "hi", F.ceil(F.col("sum") / mean).alias("parts"))
    place = F.when(F.col("lo") == F.col("hi"), F.col("tie") / float(1 << 60)).otherwise((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1))
    fine = ranged.join(F.broadcast(over), "range", "left").withColumn("part", F.coalesce(F.floor(place * F.col("parts")), F.lit(0))).drop("lo", "hi", "parts")

    # two passes of prefix sums: over ranges, then inside each
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = fine.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = table(totals.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0")), "starts")
    inside = Window.partitionBy("range", "part").orderBy("key", "tie", "id", "size")
    placed = fine.join(F.broadcast(starts), ["range", "part"]).select(
        "id", "size", "crc",
        (F.col("row0") + F.row_number().over(inside) - 1).alias("row"),
        (F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte"),
    )
    total = max(1, whole["total"])
    # a row belongs where its middle lies
    shard = F.least(F.lit(n_shards - 1), F.expr(f"cast((2 * byte + size) * {n_shards} div (2 * {total}L) as int)"))
    placed = table(placed.withColumn("shard", shard), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of df, whose ids must be distinct, into one folder a shard, in the order of slots."""
    places = assign_shards(df, n_shards, id_col, text_col).select(id_col, "shard", "slot")
    df.join(places, id_col).repartition("shard", F.floor(F.col("slot") / RANGE_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
