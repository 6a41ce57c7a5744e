"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Each text becomes the set of its distinct word shingles, hashed once to 64 bits. The top bits of a hash name its bin,
and the smallest hash of a bin is that bin's value; an empty bin borrows from the first non-empty bin of its own probe
sequence (optimal densification). Bands of bins form buckets. A bucket is a star, not a clique: its members are
compared with its two centres only, the member that shares most buckets and one drawn by hash. Links are confirmed on
full sets.

A star can miss a link between two members of a bucket that don't link to its centres. So after the first components
are known, the members of buckets that still hold two components are joined exactly, by what is rare: of each, in the
order of how many of them have a shingle, as many of the rarest are taken as it could lack in a link, and one more. Two
that link share one of these. A shingle that only one has counts among them but joins nothing, so what can't link drops
out, and two large groups of near copies that don't link share none, as what sets them apart is rarer than what they
have in common. The groups of such a shingle are stars again, with a new centre each round, as long as that joins
components; of what is left, groups of up to `SMALL` are compared pair by pair, and in larger ones those outside the
centre's component with all members, in blocks of `ASKED` by `MEMBERS`. So no link inside a bucket is lost, and no task
holds a bucket.

What can be lost is a linked pair that shares no bucket: (1 - s**4)**32 of pairs with similarity s, 6e-11 at 0.85,
5e-8 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, components, small, table

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Buckets whose open members are no more than this are finished pair by pair; larger ones in blocks.
SMALL = 64
#: Stars go on while a round leaves at most this share of the members of large buckets.
GAIN = 0.9
ASKED, MEMBERS = 256, 1024

_U = np.uint64
_SHIFT = _U(64 - (BINS - 1).bit_length())
_EDGES = np.arange(BINS, dtype=_U) << _SHIFT


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """The normalised text and the sorted distinct hashes of its shingles of `width` words.

    A-Z become a-z; a text of fewer words is one shingle; a text without words has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return b"", np.empty(0, _U)
    whole = b" ".join(found)
    if len(found) < width:
        return whole, np.array([xxhash.xxh3_64_intdigest(whole, 1)], _U)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    n = len(one) - width + 1
    out = one[:n]
    for k in range(1, width):
        out = _mix(out) + one[k : n + k]
    return whole, np.unique(_mix(out))


def _probes() -> np.ndarray:
    """Of each bin, the other bins in the order in which it asks them."""
    draw = np.random.Generator(np.random.PCG64(20240229))
    return np.array([draw.permutation(BINS) for _ in range(BINS)])


_ORDER = _probes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value for each bin from sorted distinct hashes, of which there is at least one."""
    first = np.searchsorted(hashes, _EDGES)
    full = first < np.append(first[1:], len(hashes))
    donor = np.arange(BINS)
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = full[_ORDER[empty]]
        donor[empty] = _ORDER[empty, asked.argmax(axis=1)]
    return hashes[first[donor]]


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=_U)
    for k in range(ROWS):
        out = _mix(out + rows[:, k])
    return out.view(np.int64)


def _sketches(width: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in small(batches):
                ids, sizes, d1, d2, keys = batch.column(0).to_pylist(), [], [], [], []
                for text in batch.column(1):
                    whole, found = shingle_set(text.as_py(), width)
                    sizes.append(len(found))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(whole), np.int64)
                    d1.append(int(digest[0]))
                    d2.append(int(digest[1]))
                    keys.append(bands(signature(found)) if len(found) else [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run, "id long, n long, d1 long, d2 long, bands array<long>"


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(lambda text: shingle_set(text, width)[1])
        with np.errstate(over="ignore"):
            for batch in small(batches):
                out = []
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p, q = sets(x), sets(y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in small(batches):
                for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = shingle_set(text.as_py(), width)[1].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), one, np.int64)), pa.array(found)], names=["id", "shingle"])

    return run


def _block(width: int, percent: int):
    """Links of the asking rows of a block with its other rows: those with which they share a bucket and not the root."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        others = [r for r in rows if not r["asks"]]
        by: dict[int, list[int]] = {}
        for i, r in enumerate(others):
            for bucket in r["buckets"]:
                by.setdefault(bucket, []).append(i)
        n, u = (np.array([r[c] for r in others], np.int64) for c in ("n", "u"))
        root = np.array([r["root"] for r in others], np.int64)
        sets, out = [None] * len(others), []
        with np.errstate(over="ignore"):
            for r in rows:
                if not r["asks"]:
                    continue
                near = np.unique(np.fromiter((i for bucket in r["buckets"] for i in by.get(bucket, ())), np.int64))
                near = near[root[near] != r["root"]]
                most = np.minimum(n[near] - u[near], r["n"] - r["u"])
                near = near[100 * most >= percent * (n[near] + r["n"] - most)]
                mine = shingle_set(r["text"], width)[1] if len(near) else None
                for i in near:
                    if sets[i] is None:
                        sets[i] = shingle_set(others[i]["text"], width)[1]
                    both = len(np.intersect1d(mine, sets[i], assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(sets[i]) - both):
                        out.append((min(r["id"], others[i]["id"]), max(r["id"], others[i]["id"])))
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their full sets."""
    mine = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    theirs = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    full = pairs.join(mine, "b").join(theirs, "a").select("a", "b", "x", "y")
    return table(full.mapInArrow(_confirm(width, percent), "a long, b long"), "links")


def _could(percent: int) -> str:
    """The sizes na and nb, less ua and ub shingles that nothing else has, leave room for a link."""
    most = "least(na - ua, nb - ub)"
    return f"100 * {most} >= {percent} * (na + nb - {most})"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of df.

    Two documents link if 100 * |A and B| >= percent * |A or B| for their sets of shingles of `width` words;
    component_id is the smallest id that links reach, and one document of each component is kept. Documents without
    words link with nothing. Rows with a null id are judged alone: component_id is null and they are kept. Rows that
    repeat an id are one document each and join one component if either links. Other columns of df don't matter. An
    empty table gives an empty one.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run, schema = _sketches(width)
    flat = table(docs.mapInArrow(run, schema), "sketches")
    some = flat.filter("id is not null and n > 0")

    # equal sets first: one representative for equal normalised texts
    reps = table(some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "reps")
    member = _represented(some, reps).select("id", "n", "bands", F.coalesce("rep", "id").alias("rep"))
    ones = member.filter("id = rep").select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = ones.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    inside = table(ones.join(sizes, "bucket").select("bucket", F.col("rep").alias("id"), "n", "size"), "buckets")
    people = inside.groupBy("id").agg(F.sum("size").alias("score"))
    texts = table(among(docs, "id", people.select("id")), "texts")

    ranked = inside.join(people, "id")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("score", "id", "n")).alias("hub"), F.min(F.struct(F.xxhash64("bucket", "id"), "id", "n")).alias("drawn"))
    pairs = (
        inside.select("bucket", "id", "n")
        .join(centre, "bucket")
        .select("id", "n", F.explode(F.array(F.struct(F.col("hub.id").alias("c"), F.col("hub.n").alias("m")), F.struct(F.col("drawn.id").alias("c"), F.col("drawn.n").alias("m")))).alias("s"))
        .filter("id <> s.c")
        .filter(f"100 * least(n, s.m) >= {percent} * greatest(n, s.m)")
        .select(F.least("id", "s.c").alias("a"), F.greatest("id", "s.c").alias("b"))
        .distinct()
    )
    links = _links(pairs, texts, width, percent)
    roots = table(components(links), "roots")

    rest = _rest(inside, roots)
    if not rest.isEmpty():
        rare = table(_rare(among(texts, "id", rest.select("id").distinct()), rest, width, percent), "rare")
        last = None
        while True:
            open_ = table(_open(rare, roots), "open")
            large = open_.filter(f"size > {SMALL}")
            now = large.count()
            if not now or (last is not None and now > GAIN * last):
                break
            last = now
            new = _links(_starred(large, now, percent), texts, width, percent)
            if new.isEmpty():
                break
            roots = table(_merged(roots, new), "roots")
        tiny = open_.filter(f"size <= {SMALL}")
        left, right = (tiny.select("bucket", *(F.col(c).alias(f"{c}{s}") for c in ("id", "n", "u", "root"))) for s in "ab")
        few = left.join(right, "bucket").filter("ida < idb and roota <> rootb").filter(_could(percent)).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()
        new = _links(few, texts, width, percent)
        if now:
            new = new.unionByName(_asked(large, roots, texts, width, percent))
        if not new.isEmpty():
            roots = table(_merged(roots, new), "roots")

    found = member.select("id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    named = found.groupBy("id").agg(F.min("root").alias("root"))
    out = flat.select("id", "n").join(named, "id", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(True)).alias("kept"),
    )
    return out


#: A text is hot with at least one of so many rows; there are at most so many hot ones.
HOT = 1_000


def _represented(some: DataFrame, reps: DataFrame) -> DataFrame:
    """some(d1, d2, id, ...) with `rep` of reps(d1, d2, rep, copies), null without one.

    Hot texts, at most HOT, go to every task, and their rows are then dealt out by their ids, so no task has all copies.
    """
    every = some.count()
    hot = F.broadcast(reps.filter(F.col("copies") * HOT >= every).select("d1", "d2", F.col("rep").alias("_hot")))
    cold = reps.filter(F.col("copies") * HOT < every).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("rep").alias("_cold"))
    met = some.join(hot, ["d1", "d2"], "left").withColumn("_own", F.when(F.col("_hot").isNull(), F.col("d1")).otherwise(F.xxhash64("id")))
    same = (F.col("_own") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("_hot").isNull()
    return met.join(cold, same, "left").withColumn("rep", F.coalesce("_hot", "_cold"))


def _rare(texts: DataFrame, rest: DataFrame, width: int, percent: int) -> DataFrame:
    """(bucket, id, n, u): each document's rarest shingles among texts(id, text), as buckets; u of its n shingles no other has.

    A link shares at least percent of either document's shingles, so two that link share one of the n - ceil(percent *
    n / 100) + 1 rarest of each, in one order of all shingles. Of an id with several texts all shingles are taken.
    """
    each = table(texts.mapInArrow(_shingles(width), "id long, shingle long"), "shingles")
    k = each.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1")
    sizes = rest.select("id", "n").distinct()
    shared = each.join(k, "shingle")
    often = texts.groupBy("id").agg(F.count("*").alias("texts")).filter("texts > 1")
    found = sizes.join(shared.groupBy("id").agg(F.count("*").alias("some")), "id").join(often, "id", "left")
    most = f"if(texts > 1, some, n - ceil({percent} * n / 100) + 1 - u)"
    asked = found.select("id", "n", "some", "texts", F.expr("if(texts > 1, 0L, n - some)").alias("u")).filter(f"{most} > 0")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("k", "shingle"))
    return shared.join(asked, "id").withColumn("at", rank).filter(f"at <= {most}").select(F.col("shingle").alias("bucket"), "id", "n", "u")


def _starred(large: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with one of them, drawn by hash from a component drawn by hash."""
    drawn = F.struct(F.xxhash64("root", F.lit(turn)).alias("r"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "u", "root")
    star = large.groupBy("bucket").agg(F.min(drawn).alias("c"))
    met = large.join(star, "bucket").filter("root <> c.root").select(F.col("id").alias("ida"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("c.id").alias("idb"), F.col("c.n").alias("nb"), F.col("c.u").alias("ub"))
    return met.filter(_could(percent)).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()


def _asked(large: DataFrame, roots: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links in large buckets, by blocks: (hub, part of those who ask, part of the members)."""
    hubs = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("hub"))
    at = large.join(hubs, "bucket")
    rows = at.groupBy("hub", "id", "n", "u", "root").agg(F.collect_set("bucket").alias("buckets"))
    main = roots.select(F.col("node").alias("hub"), F.col("root").alias("main"))
    rows = table(rows.join(main, "hub", "left").withColumn("asks", F.col("root") != F.coalesce("main", "hub")).drop("main"), "large")
    parts = rows.groupBy("hub").agg(F.ceil(F.count_if("asks") / ASKED).alias("nq"), F.ceil(F.count("*") / MEMBERS).alias("nm")).filter("nq > 0")
    rows = rows.join(parts, "hub")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = rows.filter("asks").withColumn("q", part("nq")).withColumn("m", every("nm"))
    others = rows.withColumn("asks", F.lit(False)).withColumn("m", part("nm")).withColumn("q", every("nq"))
    both = asking.select("hub", "q", "m", "id", "n", "u", "root", "buckets", "asks").unionByName(others.select("hub", "q", "m", "id", "n", "u", "root", "buckets", "asks"))
    full = both.join(texts, "id").groupBy("hub", "q", "m").applyInArrow(_block(width, percent), "a long, b long")
    return table(full.distinct(), "links")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: their components are found among the roots alone."""
    of = lambda side: F.coalesce(F.col(f"{side}root"), F.col(side)).alias(side)
    a, b = (roots.select(F.col("node").alias(s), F.col("root").alias(f"{s}root")) for s in "ab")
    up = components(links.join(a, "a", "left").join(b, "b", "left").select(of("a"), of("b"))).withColumnRenamed("root", "top")
    every = roots.unionByName(up.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
    return every.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _rest(inside: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets of three or more that hold two components."""
    named = inside.filter("size > 2").join(roots, inside["id"] == roots["node"], "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    two = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    return named.join(two, "bucket", "left_semi").select("bucket", "id", "n")


def _open(rest: DataFrame, roots: DataFrame) -> DataFrame:
    named = rest.join(roots, rest["id"] == roots["node"], "left").select("bucket", "id", "n", "u", F.coalesce("root", "id").alias("root"))
    two = named.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket", "size")
    return named.join(two, "bucket")
