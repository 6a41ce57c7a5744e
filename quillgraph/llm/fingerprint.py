"""Fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

A text's 5-word shingles are hashed once. The high bits of a hash choose one of `BINS` bins, whose value is its
smallest hash; an empty bin takes the value of the non-empty bin that comes first in its own random order. `BITS` low
bits of each value are packed into words of 64 bits. Two texts' likeness is the share of equal values, less what
chance makes equal. All of it is built-in array functions, so a text never leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, words

BINS, BITS, WIDTH = 128, 4, 5
PER_WORD = 64 // BITS
#: Bits of a hash below its bin's number; the sign bit stays 0.
LOW = 63 - (BINS - 1).bit_length()
#: Rows of one task where documents stand in the order of their ids.
RUN_ROWS, FEW, MANY = 500, 64, 1 << 16


def shingles(text: Column) -> Column:
    """Hashes, of 63 bits, of the text's shingles with repeats; a text of fewer words is one shingle, one of none has none."""
    hash_ = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    return let(
        words(text),
        lambda w: F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WIDTH + 1, F.lit(1))), lambda i: hash_(F.slice(w, i, WIDTH))))
        .when(F.size(w) > 0, F.array(hash_(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def values(text: Column) -> Column:
    """One value for each bin, or an empty array for a text without words, as an empty one; null of a null text."""
    bin_ = lambda v: F.shiftright(v, LOW)
    # the largest number of each bin stands for "empty", so that the first of each bin is there to find
    ends = F.array(*(F.lit(((b + 1) << LOW) - 1) for b in range(BINS)))
    is_end = lambda v: v.bitwiseAND(F.lit((1 << LOW) - 1)) == F.lit((1 << LOW) - 1)
    first = lambda s: F.filter(s, lambda v, i: (i == 0) | (bin_(F.get(s, i - 1)) != bin_(v)))
    ask = lambda bins, i: F.array_min(F.transform(bins, lambda v: F.struct(F.xxhash64(i, bin_(v)).alias("turn"), v.alias("v")))).getField("v")
    fill = lambda bins: let(
        F.filter(bins, lambda v: ~is_end(v)),
        lambda full: F.when(F.size(full) == BINS, bins).otherwise(F.transform(bins, lambda v, i: F.when(is_end(v), ask(full, i)).otherwise(v))),
    )
    made = let(F.sort_array(F.concat(shingles(text), ends)), lambda s: F.when(F.size(s) > BINS, fill(first(s))).otherwise(F.array().cast("array<bigint>")))
    return made


def packed(vals: Column) -> Column:
    """BITS bits of each value, PER_WORD to a 64-bit word.

    The bits are those of the value hashed with its bin's number, so that bins which hold one borrowed value agree by
    chance one by one and not all at once.
    """
    low = F.lit((1 << BITS) - 1)
    bits = F.transform(vals, lambda v, i: F.xxhash64(v, i).bitwiseAND(low))
    part = lambda own: lambda j: F.aggregate(F.slice(own, j * PER_WORD + 1, PER_WORD), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v))
    words_ = let(bits, lambda own: F.transform(F.array(*map(F.lit, range(BINS // PER_WORD))), part(own)))
    return F.when(F.size(vals) > 0, words_).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column) -> Column:
    return let(values(text), packed)


def hex_of(print_: Column) -> Column:
    return F.concat_ws("", F.transform(print_, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: equal values, less the 2**-BITS of unequal ones that agree by chance.

    Two texts without words are alike, one of them is unlike any other.
    """
    ones = 0
    for k in range(PER_WORD):
        ones |= 1 << (BITS * k)

    def unlike(x: Column) -> Column:
        any_ = x
        for k in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(any_.bitwiseAND(F.lit(ones)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    est = ((BINS - differ) / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), est))).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)


def in_runs(df: DataFrame, key: str, tie: str) -> DataFrame:
    """df with a column _run: rows in the descending order of an integer key, null last, then of `tie`, cut into runs of a few rows.

    Runs are stretches between approximate quantiles of the key, so one task holds one run however large the table is;
    a run of one key (or of null keys) with too many rows is cut again, evenly by the 64-bit hash `tie`.
    """
    n, every = df.agg(F.count(key), F.count("*")).first()
    runs, own = min(MANY, max(FEW, n // RUN_ROWS)), max(RUN_ROWS, every // MANY)
    q = df.agg(F.percentile_approx(key, [i / runs for i in range(1, runs)], 20 * runs)).first()[0] or []
    # a key that fills more than one stretch has one of its own
    cuts = sorted(set(q) | {max(a - 1, -(1 << 63)) for a, b in zip(q, q[1:], strict=False) if a == b}, reverse=True)
    steps, k = [], 1
    while k <= len(cuts):
        steps.insert(0, k)
        k *= 2
    low = F.lit(0)
    if cuts:
        bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")
        low = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(lo + s <= len(cuts), F.when(F.get(bounds, lo + s - 1) >= F.col(key), lo + s).otherwise(lo)).otherwise(lo))
    coarse = df.withColumn("_run", F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(low).cast("long"))
    sums = coarse.groupBy("_run").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    over = sums.filter(f"n > {4 * own} and lo <=> hi").select("_run", F.ceil(F.col("n") / own).alias("_parts"))
    # at most one row for each run, and parts add no more than MANY runs
    part = F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * F.col("_parts"))
    fine = coarse.join(F.broadcast(over), "_run", "left").withColumn("_part", F.least(F.coalesce(part, F.lit(0)), F.coalesce(F.col("_parts") - 1, F.lit(0))))
    return fine.withColumn("_run", F.col("_run") * F.lit(1 << 32) + F.col("_part")).drop("_part", "_parts")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint array<long>): one row for each row of df; a null text counts as empty. Equal texts, equal fingerprints."""
    return df.select(id_col, fingerprint(F.col(text_col)).alias("fingerprint"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row for each row of df.

    The edited text of a document keeps its first half, and the first characters of the next document, by descending
    id, take the place of the rest; after the last comes the first. A null text counts as empty, a null id stands last;
    rows that repeat an id stand in the order of their texts' hashes. A single document is its own next. Other columns
    of df don't matter; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    placed = in_runs(docs, "id", "tie")
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("text")]
    # the first row of a run is also, as a guest, the last of the run before it; texts stay out of the one window over runs
    first = table(first_rows(placed), "firsts")
    last_run = first.agg(F.max("_run")).first()[0]
    if last_run is None:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(F.lit(0.0).alias(c) for c in ("near_edited", "near_next")))
    before = first.select("_run", F.coalesce(F.lag("_run").over(Window.orderBy("_run")), F.lit(last_run)).alias("_before"))
    guests = first.join(before, "_run").select("id", "text", "tie", F.col("_before").alias("_run")).withColumn("guest", F.lit(True))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    own = Window.partitionBy("_run").orderBy(F.col("guest"), *order)
    with_next = rows.withColumn("next", F.lead("text").over(own))
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(coalesce(next, ''), 1, cast(floor(char_length(text) / 2) as int))"))
    made = with_next.select(
        "id", "tie", "text", "_run", "guest",
        F.char_length("text").cast("long").alias("n_chars"),
        fingerprint(F.col("text")).alias("print"),
        F.when(~F.col("guest"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("print")))).alias("e"),
    )
    done = made.withColumn("next_print", F.lead("print").over(own)).filter(~F.col("guest"))
    return done.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        hex_of(F.col("print")).alias("fingerprint"),
        hex_of(F.col("e.print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("e.print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def first_rows(placed: DataFrame) -> DataFrame:
    """The first row of each run, by the largest id and then the smallest hash."""
    key = F.struct(F.col("id").isNull(), -F.col("id").cast("decimal(20,0)"), "tie")
    top = placed.groupBy("_run").agg(F.min(key).alias("key"))
    return placed.join(F.broadcast(top), "_run").filter(key.eqNullSafe(F.col("key"))).groupBy("_run", "id", "tie").agg(F.min("text").alias("text"))
