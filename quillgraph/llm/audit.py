"""How filters interact: what each order of them keeps, removes, and would have removed.

A document is a mask of the filters that it fails. Masks are counted by part, with their labels; the counts of a part
are the rows of a small matrix, and integer matrices with a row for each mask and a column for each step of each order
give all figures as one product a part. So documents are read once, and the orders cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, words

FILTERS = "ABCDE"
#: Limits of the first four filters: words, distinct words of 100, capitals of 100 characters, and the marks.
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails; null counts as empty. Needs the text's words as `words`."""
    size = F.size("words")
    failed = (
        size < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT * size,
        100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS * F.char_length(text),
        text.rlike(MARKS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, text_hash, mask, n): rows of docs, those equal in all of it as one; bit 4 of mask is for copies of a smaller id's text.

    The first of each text is found by one grouped minimum of ids, which each task takes before anything is shuffled,
    and meets the rows by id and text together, so the copies of one text are not brought together. Null ids are
    neither copies nor originals; equal ids aren't smaller than each other. Texts are equal if their SHA-256 is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), words(F.col(text_col)).alias("words"))
    told = read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("text_hash"), failures(F.col("text")).alias("mask"))
    rows = table(told.groupBy("id", "part", "text_hash", "mask").agg(F.count("*").alias("n")), "masks")
    firsts = rows.filter("id is not null").groupBy("text_hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = rows.filter("id is not null").join(firsts, ["id", "text_hash"], "left")
    marked = known.withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16)).drop("first")
    return marked.select(*rows.columns).unionByName(rows.filter("id is null"))


def histograms(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, counts): for each mask that a part has, (mask, documents, good, toxic); at most 32 a part.

    A document is good or toxic if any row of its labels says so.
    """
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    met = rows.filter("id is not null").join(said.filter("good + toxic > 0"), "id", "left").select("part", "mask", "n", "good", "toxic")
    met = met.unionByName(rows.filter("id is null").select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))
    sums = met.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))


@cache
def outcomes(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The columns (order, step), and for each outcome its integer matrix of 2**n masks by n * n! columns."""
    columns = [("".join(p), s) for p in permutations(filters) for s in range(1, len(filters) + 1)]
    mask = np.arange(1 << len(filters))
    fails = {f: mask >> i & 1 for i, f in enumerate(filters)}
    found = {k: np.zeros((len(mask), len(columns)), np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for j, (order, step) in enumerate(columns):
        own = fails[order[step - 1]]
        before = np.clip(sum((fails[f] for f in order[: step - 1]), np.zeros_like(mask)), 0, 1)
        found["kept"][:, j] = (1 - before) * (1 - own)
        found["removed"][:, j] = (1 - before) * own
        found["redundant"][:, j] = before * own
        found["unique_fails"][:, j] = own * (sum(fails.values()) == 1)
    return columns, found


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts' histograms times the matrices of outcomes: a row for each part, order and step."""
    columns, found = outcomes()
    orders, steps = [c[0] for c in columns], np.array([c[1] for c in columns], np.int32)
    own = np.array([FILTERS.index(o[s - 1]) for o, s in columns])
    of_filter = (own[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    for batch in batches:
        for part, counts in zip(batch.column(0), batch.column(1)):
            stack = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in counts.as_py():
                stack[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
            of_all = {k: stack[0] @ m for k, m in found.items()}
            lost = stack[1:] @ found["removed"]
            shapley = (of_all["removed"] @ of_filter)[own]
            figures = [*of_all.values(), *lost, shapley]
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(orders), pa.string()), pa.array(orders), pa.array(steps), *map(pa.array, figures)], names=["part", "filter_order", "step", *FIGURES])


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step and FIGURES): 600 rows for each value of part_col, zeros included.

    A null part is the empty string. A null text is empty; all empty texts are equal, so all but that of the smallest
    id fail E. Rows with a null id have no labels and don't fail E. Repeated rows count each; labels that repeat count
    once. An empty table gives no rows. Extra columns don't matter.
    """
    told = masks(docs.select(id_col, text_col, part_col), id_col, text_col, part_col)
    return histograms(told, labels.select(id_col, "quality", "toxic"), id_col).mapInArrow(_product, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))
