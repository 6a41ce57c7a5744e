"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in the order of a keyed hash, form one line of words, cut into blocks of `BLOCK` words. A target
of k times a source's words and a rest takes every block k times, and of the rest as many blocks as it needs, the first
in a permutation of the source's blocks, the last of them shortened, so that a source gives its target to the word.
How many of its drawn blocks each output shard gets is decided on a tree: a node splits its counts between its two
halves of the shards by one multivariate-hypergeometric draw, so that quotas are met exactly and every shard looks like
the whole. The drawn blocks, permuted once more, are dealt out as disjoint runs of those lengths, and inside a shard a
keyed hash orders them. What a document gives to the mix is what lies of it in the blocks that shards drew.

Sources are rows of a table. The tree is walked twice: on the driver for chunks of `CHUNK` sources, then in a task for
the sources of a chunk, given what the chunk's shards get. Word offsets come from prefix sums over cells of a source,
then inside each cell, so a source with most of the rows is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.history import number
from .common import table, words

BLOCK = 2048
CELL_ROWS, MANY = 4_096, 1 << 16
#: Sources that one task splits; the driver sees one row for so many.
CHUNK = 4_096
#: Up to so many sources are handed to every task (300 bytes each); more are joined by salted keys.
FEW_SOURCES, SALTS = 1 << 14, 32
#: From so many blocks on, numpy has no hypergeometric draw.
LARGE = 1_000_000_000
SEED = 17


def level(sources: DataFrame, most: float) -> float:
    """The common level of target to weight of sources(source_size, weight) that are not cut at `most` times their size.

    Shares are by weight; what the cut takes from sources above their limit goes to the others by weight, again until
    none is above. A round is one aggregate over the sources.
    """
    cap, found = F.lit(float(most)) * F.col("source_size"), None
    while True:
        cut = cap / F.col("weight") < F.lit(found) if found is not None else F.lit(False)
        sums = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(cut, cap)).alias("cut"), F.sum(F.when(~cut, F.col("weight"))).alias("weight")).first()
        if not sums["weight"]:
            return found or 0.0
        now = (float(sums["all"]) - float(sums["cut"] or 0.0)) / float(sums["weight"])
        if found is not None and now <= found:
            return found
        found = now


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n balls drawn from good + bad ones are good, for any counts.

    Large counts invert the distribution over 12 standard deviations on either side of its mean.
    """
    if max(good, bad) < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    whole = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mean, sd = n * (good / whole), math.sqrt(n * (good / whole) * (bad / whole) * ((whole - n) / max(1, whole - 1)))
    a, b = max(lo, int(mean - 12 * sd) - 9), min(hi, int(mean + 12 * sd) + 9)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n balls, drawn from counts of each colour, have each colour."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts):
        own = int(counts[i])
        left -= own
        out[i] = got = hypergeometric(rng, own, left, n) if 0 < n < own + left else min(n, own)
        n -= got
    return out


def split(counts: np.ndarray, quotas: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks each shard gets: shards x sources; columns sum to counts and rows to quotas."""
    if len(quotas) == 1:
        return counts[None, :]
    half = len(quotas) // 2
    left = draw(counts, int(sum(quotas[:half])), rng)
    return np.concatenate([split(left, quotas[:half], rng), split(counts - left, quotas[half:], rng)])


def even(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def _permutation(rng: np.random.Generator, n: int) -> tuple[int, int]:
    """Step and offset: (k * step + offset) mod n visits every number below n once, and the product fits 62 bits."""
    step = int(rng.integers(1, max(2, min(n, (1 << 61) // n))))
    while math.gcd(step, n) != 1:
        step += 1
    return step, int(rng.integers(0, n))


def quota(size: int, goal: int, block: int, rng: np.random.Generator) -> dict[str, int]:
    """What a source of `size` words gives for `goal` words: whole repetitions, then `q` of its `nb` blocks.

    The block of rank q - 1 is shortened to `keep` words. `n` blocks are drawn in all.
    """
    nb = max(1, -(-size // block))
    whole, rest = divmod(goal, size) if size else (0, 0)
    step, off = _permutation(rng, nb)
    short, at = size - (nb - 1) * block, ((nb - 1) * step + off) % nb
    q = -(-rest // block)
    if at < q and (q - 1) * block + short < rest:
        q += 1
    keep = rest - (q - 1) * block + (block - short if at < q - 1 else 0) if q else 0
    n = whole * nb + q
    step2, off2 = _permutation(rng, max(1, n))
    return {"nb": nb, "whole": whole, "q": q, "keep": keep, "step": step, "off": off, "n": n, "step2": step2, "off2": off2}


QUOTA = ("nb", "whole", "q", "keep", "step", "off", "n", "step2", "off2")


def dealt(sources: DataFrame, n_shards: int, block: int, seed: int) -> DataFrame:
    """sources(sid, source, source_size, target, goal) with the columns of quota() and `ends`, the running sums of what the shards get."""
    fields = ", ".join(f"{c} long" for c in QUOTA)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [quota(s, g, block, np.random.Generator(np.random.PCG64([seed, i]))) for i, s, g in zip(*(batch.column(k).to_pylist() for k in (0, 2, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[c] for r in rows], pa.int64()) for c in QUOTA)], names=[*batch.schema.names, *QUOTA])

    base = "sid long, source string, source_size long, target double, goal long"
    kept = table(sources.select("sid", "source", "source_size", "target", "goal").mapInArrow(drawn, f"{base}, {fields}"), "drawn").withColumn("chunk", F.expr(f"sid div {CHUNK}"))
    sums = kept.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy("chunk").collect()
    counts = np.array([r["n"] for r in sums], np.int64)
    parts = split(counts, even(int(counts.sum()), n_shards), np.random.Generator(np.random.PCG64(seed)))
    given = sources.sparkSession.createDataFrame([(r["chunk"], parts[:, i].tolist()) for i, r in enumerate(sums)], "chunk long, quotas array<long>")

    def shared(group: pa.Table) -> pa.Table:
        group = group.sort_by("sid")
        rng = np.random.Generator(np.random.PCG64([seed, group["chunk"][0].as_py(), 1]))
        ends = split(np.array(group["n"].to_pylist(), np.int64), group["quotas"][0].as_py(), rng).cumsum(axis=0)
        return group.drop_columns(["chunk", "quotas"]).append_column("ends", pa.array(ends.T.tolist(), pa.list_(pa.int64())))

    return table(kept.join(F.broadcast(given), "chunk").groupBy("chunk").applyInArrow(shared, f"{base}, {fields}, ends array<long>") if sums else kept.drop("chunk").withColumn("ends", F.array().cast("array<long>")), "dealt")


def _with_sources(rows: DataFrame, about: DataFrame, key: str, few: bool) -> DataFrame:
    """rows with the columns of their source: all sources go to every task if they are few, else each to SALTS parts."""
    theirs = about.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if few:
        return rows.join(F.broadcast(theirs), same).drop("_key")
    theirs = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("_salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    return mine.join(theirs, same & (F.col("_salt") == F.col("_part"))).drop("_key", "_salt", "_part")


def _mixed(docs: DataFrame, weights: Sequence[float], most: float, n_shards: int, block: int, seed: int) -> DataFrame:
    """A row for each of docs(row, id, text, source), with `pieces`: what the shards drew of it."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    base = table(
        docs.select("row", "id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long").alias("h")),
        "base",
    )
    found = number(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), [F.col("source").isNull(), F.col("source")], "sid")
    turns = F.array(*(F.lit(float(w)) for w in weights))
    sources = table(found.withColumn("weight", F.get(turns, F.pmod("sid", F.lit(len(weights))).cast("int"))), "sources")
    whole = sources.agg(F.count("*").alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level(sources, most)) * F.col("weight"))
    goals = sources.select("sid", "source", "source_size", target.alias("target"), F.floor(target + 0.5).alias("goal"))
    about, few = dealt(goals, n_shards, block, seed), whole["sources"] <= FEW_SOURCES
    known = _with_sources(base, about.select("sid", "source"), "source", few)

    bits = min(MANY, max(1, whole["rows"] // CELL_ROWS)).bit_length() - 1
    cells = known.withColumn("cell", F.shiftright("h", 60 - bits).cast("int"))
    sums = cells.groupBy("sid", "cell").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "cell", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("cell0"))
    inside = Window.partitionBy("sid", "cell").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("to", F.sum("size").over(inside)).join(starts, ["sid", "cell"]).withColumn("at", F.expr("cell0 + to - size"))

    full = _with_sources(placed, about.drop("source"), "sid", few)
    met = f"transform(sequence(0L, whole), c -> transform(sequence(at div {block}, (at + size - 1) div {block}), b -> struct(c, b, pmod(b * step + off, nb) as p)))"
    cut = f"transform(flatten({met}), x -> struct(x.c, x.b, x.p, greatest(at, x.b * {block}) as lo, least(at + size, x.b * {block} + if(x.c = whole and x.p = q - 1, keep, {block}L)) as hi))"
    taken = f"filter({cut}, x -> (x.c < whole or x.p < q) and x.lo < x.hi)"
    numbered = f"transform({taken}, x -> struct(x.c, x.lo, x.hi, pmod((x.c * nb + x.p) * step2 + off2, n) as k))"
    made = "transform(numbered, x -> struct(x.c as copy, x.lo - at as start, x.hi - x.lo as length, x.k as block, size(filter(ends, e -> e <= x.k)) as shard, x.c * source_size + x.lo as at))"
    return (
        full.withColumn("numbered", F.expr(f"if(size > 0, {numbered}, null)"))
        .withColumn("made", F.expr(made))
        .select("row", "id", "source", "size", "source_size", "target", F.expr(f"transform(made, x -> struct(x.copy, x.start, x.length, x.block, x.shard, xxhash64(x.shard, sid, x.block, {seed}) as seat, x.at))").alias("pieces"))
    )


def _documents(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, n_shards: int = 16, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """One row for each row of df: (row, id, source, size, source_size, target, pieces).

    Sources in the order of their code points, null last, have the weights by turns. A piece is `length` words of the
    document from word `start` on, in its copy-th repetition, in the drawn block `block` of its source, which lies in
    `shard`; `seat` orders a shard's blocks, and `at` is the place in the source's repeated line. Rows of which the mix
    takes nothing have no pieces (null without words). `row` tells rows apart that repeat an id. Null texts have no
    words; null ids are documents like others. Rows equal in id and text meet in one task, as numbers. Reruns give the
    same pieces, however the table is partitioned; an empty table gives an empty one; other columns don't matter.
    """
    return _mixed(_documents(df, id_col, text_col, source_col), weights, most, n_shards, block, seed)


def taken(mixed: DataFrame) -> DataFrame:
    """(id, size, source_size, target, taken, n_blocks, shards) of each row of mix(): words, blocks and shards that hold some of it."""
    own = F.coalesce(F.col("pieces"), F.array().cast(mixed.schema["pieces"].dataType))
    total: Column = F.aggregate(own, F.lit(0).cast("long"), lambda s, p: s + p["length"])
    return mixed.select("id", "size", "source_size", "target", total.alias("taken"), F.size(own).cast("long").alias("n_blocks"), F.array_sort(F.array_distinct(F.transform(own, lambda p: p["shard"]))).alias("shards"))


def mixed_documents(df: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The texts of the mix with the columns of `documents`: each copy of a document that the mix takes is a row.

    Documents are kept whole: a copy goes in if the block that holds its middle word was drawn, so one of any length
    goes in as often as its words would; what has no words stays out. A copy belongs to the shard of that block;
    partitions are ranges of shards and their seats, and each is in that order, in a block by the place in the source's
    line. So a document's copies lie apart as its blocks were dealt. Nulls are as in mix().
    """
    kept = table(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "mixed")
    pieces = _mixed(kept.select("row", F.col("doc.doc_id").alias("id"), "doc.text", F.col("doc.source").cast("string").alias("source")), weights, most, 16, BLOCK, seed)
    middle = F.explode(F.expr("filter(pieces, p -> p.start <= size div 2 and size div 2 < p.start + p.length)"))
    placed = kept.join(pieces.select("row", middle.alias("p")).select("row", "p.shard", "p.seat", "p.at"), "row")
    order = ("shard", "seat", "at")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc.*")
