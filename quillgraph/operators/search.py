"""Full-text, similarity and vector search, and the fusion of their ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import dot, hamming, text_fingerprint
from ..scratch import table
from .history import number

#: BM25 and rank fusion: the usual parameters.
K1, B, RRF_K = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def with_term_starts(docs: DataFrame, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """(*keep, ts, at): a row's terms in order, and the places where another one begins."""
    own = docs.select(*keep, F.sort_array(tokens(F.col(text_col))).alias("ts"))
    starts = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
    return own.select("*", F.when(F.size("ts") > 0, starts).otherwise(F.array().cast("array<int>")).alias("at"))


def term_counts_of_row() -> Column:
    """(term, tf) of with_term_starts(), as an array."""
    tf = lambda i, k: (F.coalesce(F.get("at", k + 1), F.size("ts")) - i).cast("long")
    return F.transform("at", lambda i, k: F.struct(F.get("ts", i).alias("term"), tf(i, k).alias("tf")))


def row_postings(docs: DataFrame, id_col: str = "page", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl) of each row of docs by itself, counted where the row lies: nothing is moved or kept."""
    own = with_term_starts(docs, F.col(id_col).alias("id"), text_col=text_col).filter(F.size("ts") > 0)
    return own.select("id", F.size("ts").cast("long").alias("dl"), F.inline(term_counts_of_row())).select("term", "id", "tf", "dl")


def postings(docs: DataFrame, id_col: str = "page", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): the inverted index. Write it partitioned or bucketed by term to search it again."""
    return whole_postings(row_postings(docs, id_col, text_col))


def whole_postings(rows: DataFrame) -> DataFrame:
    """Postings of rows, those of rows with one id and length added up."""
    return rows.groupBy("term", "id", "dl").agg(F.sum("tf").alias("tf"))


def term_counts(docs: DataFrame, id_col: str = "page", text_col: str = "text") -> DataFrame:
    """(term, df, n): in how many documents a term is, by their ids, and how often.

    Words and a row's distinct words are counted by term where they lie, so a term and not a posting is moved; only terms
    of ids that several rows have go by id first. A null id is no document, but its terms count in n.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    often = table(own.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("often")), "often")
    apart = not often.isEmpty()
    own = own.join(often, own["id"] == often["often"], "left") if apart else own.withColumn("often", F.lit(None))
    twice = F.array(F.struct(F.lit(False).alias("once"), "ts"), F.struct(F.lit(True).alias("once"), F.array_distinct("ts").alias("ts")))
    each = own.select("id", "often", tokens(F.col("text")).alias("ts")).select("id", "often", F.inline(twice)).select("id", "often", "once", F.explode("ts").alias("term"))
    rows, n = F.count(F.when(F.col("once"), F.col("id"))), F.count(F.when(~F.col("once"), 1))
    if not apart:
        return each.groupBy("term").agg(rows.alias("df"), n.alias("n"))
    by_id = each.groupBy("term", "often").agg(rows.alias("rows"), n.alias("n"))
    return by_id.groupBy("term").agg(F.sum(F.when(F.col("often").isNull(), F.col("rows")).otherwise(1)).alias("df"), F.sum("n").alias("n"))


def bm25(index: DataFrame, n_docs: int, mean_length: float, query: str, limit: int | None = None) -> DataFrame:
    """(id, score) of the documents that hold any term of the query, best first; ties by id. All of them without a limit."""
    terms = sorted({t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    hits = index.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    ranked = hits.join(df, "term").groupBy("id").agg(F.sum(idf * tf).alias("score")).orderBy(F.desc("score"), "id")
    return ranked if limit is None else ranked.limit(limit)


def search(docs: DataFrame, query: str, limit: int | None = None, id_col: str = "page", text_col: str = "text") -> DataFrame:
    """bm25 over documents that aren't indexed. Only the query's terms leave the scan; sizes come from the same pass's totals."""
    sized = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    totals = sized.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("mean")).first()
    terms = sorted({t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    want = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    hits = sized.select("id", F.size("ts").cast("long").alias("dl"), F.explode(F.filter("ts", lambda t: F.array_contains(want, t))).alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    return bm25(hits, totals["n"], totals["mean"] or 1.0, query, limit)


def line_matches(docs: DataFrame, query: str, id_col: str = "page", text_col: str = "text", around: int = 40) -> DataFrame:
    """(id, line, column, context): each line of the documents that holds a term of the query, at its first place.

    Terms are parts of words. Of several terms in a line, the longest context stays.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "text"))
    out = None
    for term in sorted({t for t in query.lower().split()}):
        at = F.locate(term, F.lower("text"))
        start = F.greatest(at - around, F.lit(1))
        one = lines.filter(at > 0).select("id", (F.col("n") + 1).alias("line"), at.alias("column"), F.substring(F.col("text"), start, at - start + len(term) + around).alias("context"))
        out = one if out is None else out.unionByName(one)
    best = Window.partitionBy("id", "line").orderBy(F.desc(F.length("context")), "column")
    return out.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def with_headings(hits: DataFrame, headings: DataFrame) -> DataFrame:
    """hits(path, offset, ...) with the last heading at or before the offset: an as-of join in one window."""
    cols = [c for c in hits.columns if c not in ("path", "offset")]
    left = hits.select("path", "offset", F.struct(*cols).alias("_hit"), F.lit(None).cast("struct<text:string,level:int>").alias("_h"))
    right = headings.select("path", "offset", F.lit(None).cast(left.schema["_hit"].dataType).alias("_hit"), F.struct("text", F.col("level").cast("int").alias("level")).alias("_h"))
    upto = Window.partitionBy("path").orderBy("offset", F.col("_hit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last("_h", ignorenulls=True).over(upto)).filter("_hit is not null")
    return both.select("path", "offset", "_hit.*", F.col("_last.text").alias("heading"), F.col("_last.level").alias("heading_level"))


def fingerprints(docs: DataFrame, id_col: str = "page", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_fingerprint(F.col(text_col)).alias("fingerprint"))


def similar(prints: DataFrame, text: str, threshold: int = 12, limit: int = 10) -> DataFrame:
    """(id, distance): fingerprints at most threshold bits from the text's, nearest first, ties by id."""
    from ..functions.hashes import fingerprint_of

    away = hamming(F.col("fingerprint"), F.lit(fingerprint_of(text)))
    return prints.select("id", away.alias("distance")).filter(F.col("distance") <= threshold).orderBy("distance", "id").limit(limit)


#: Parts of a fingerprint that are compared by equality.
PARTS, PART_BITS = 4, 16


def _radii(threshold: int) -> list[int]:
    """How many bits each part may differ in: of two fingerprints at most threshold bits apart, one part is that near."""
    each, more = divmod(threshold, PARTS)
    return [each if p <= more else each - 1 for p in range(PARTS)]


def _masks(threshold: int) -> list[tuple[int, int]]:
    """(part, mask): every difference that a part may have; 9,080 with a threshold of 16."""
    return [(p, sum(1 << b for b in bits)) for p, r in enumerate(_radii(threshold)) for n in range(r + 1) for bits in combinations(range(PART_BITS), n)]


#: Radii that are tried before the threshold: a question goes on only while it has found too few.
STEPS = (0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 16)


def similar_all(prints: DataFrame, questions: DataFrame, threshold: int = 12, limit: int = 10) -> DataFrame:
    """(question, rank, id, distance): for each of questions(question, fingerprint) what similar() gives, nearest first, ties by id.

    Multi-index hashing: fingerprints are cut into parts, and one part of two that are near differs in few bits, so
    questions ask for their own parts with all such differences and meet fingerprints by equality. Equal fingerprints
    meet once, with the `limit` smallest ids of each, as no more of them can be among the nearest. Radii grow: a question
    that has `limit` ids within one asks no further, so where very many lie near each other their pairs aren't made. A null
    fingerprint is near nothing, a null id is none. threshold is below 20.
    """
    if threshold >= 5 * PARTS:
        raise ValueError("a threshold of so many bits is a comparison with everything")
    first = Window.partitionBy("fingerprint").orderBy("id")
    few = prints.filter("fingerprint is not null and id is not null").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit).select("id", "fingerprint")
    few = table(few, "few")
    have = table(few.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first")), "prints")
    asked, near_ = table(questions.select(F.col("fingerprint").alias("ask")).filter("ask is not null").distinct(), "asked"), None
    for radius in [*(r for r in STEPS if r < threshold), threshold]:
        found = table(_nearest(asked, have, radius, limit), "near")
        if radius < threshold:
            full = found.groupBy("ask").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).select("ask")
            asked, found = table(asked.join(full, "ask", "left_anti"), "asked"), found.join(full, "ask", "left_semi")
        near_ = found if near_ is None else near_.unionByName(found)
        if asked.isEmpty():
            break
    hits = near_.join(few, "fingerprint").select(F.col("ask").alias("_ask"), "id", "distance")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("_ask").orderBy("distance", "id"))).filter(F.col("rank") <= limit)
    return questions.select("question", F.col("fingerprint").alias("_ask")).join(best, "_ask").select("question", "rank", "id", "distance")


def _nearest(asked: DataFrame, have: DataFrame, radius: int, limit: int) -> DataFrame:
    """(ask, fingerprint, distance, n): of each ask the `limit` nearest fingerprints within a radius, ties by their first id.

    A pair meets once for each part that is near enough, and counts at the first of these.
    """
    if not radius:
        return asked.join(have, F.col("ask") == F.col("fingerprint")).select("ask", "fingerprint", F.lit(0).alias("distance"), "n")
    part = lambda c, p: F.shiftrightunsigned(c, PART_BITS * p).bitwiseAND((1 << PART_BITS) - 1)
    parts = lambda c: F.posexplode(F.array(*(part(c, p) for p in range(PARTS)))).alias("part", "key")
    masks = F.broadcast(asked.sparkSession.createDataFrame(_masks(radius), "part int, mask long"))
    keys = asked.select("ask", parts("ask")).join(masks, "part").select("ask", "part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    ask, own = F.col("ask"), F.col("fingerprint")
    at = F.coalesce(*(F.when(hamming(part(ask, p), part(own, p)) <= r, p) for p, r in enumerate(_radii(radius))))
    pairs = keys.join(have.select("*", parts("fingerprint")), ["part", "key"]).withColumn("distance", hamming(ask, own)).filter((F.col("distance") <= radius) & (F.col("part") == at))
    nearest = Window.partitionBy("ask").orderBy("distance", "first")
    return pairs.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= limit).select("ask", "fingerprint", "distance", "n")


def nearest_literals(literals: DataFrame, wanted: str, threshold: int = 16, limit: int = 5) -> DataFrame:
    return similar(literals.select(F.col("literal").alias("id"), text_fingerprint("literal").alias("fingerprint")), wanted, threshold, limit)


def vector_top(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k vectors with the largest dot product, ties by id."""
    score = dot(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def embed_missing(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunks(content_hash, ...) with the vectors of known(content_hash, embedding); null where one is to be made."""
    return chunks.join(known.select("content_hash", "embedding").dropDuplicates(["content_hash"]), "content_hash", "left")


def stale_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Places of new(path, idx, content_hash) whose chunk is new or another than before."""
    before = old.select("path", "idx", F.col("content_hash").alias("_old"))
    return new.join(before, ["path", "idx"], "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).select("path", "idx")


def ranked_pages(hits: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """(page, rank): hits in order, the first of each page only, ranked from 1; all pages unless there is a limit."""
    first = Window.partitionBy("page").orderBy(*order)
    one = hits.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    if limit is None:
        return number(one, order, "rank", 1).select("page", F.col("rank").cast("int").alias("rank"))
    return one.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("page", "rank")


def fuse_ranks(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(page, score): the sum of 1 / (k + rank) over the lists(page, rank)."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("page").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def near(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The results(page, ...) that lie among pages(node)."""
    return results.join(pages.select(F.col("node").alias("page")).distinct(), "page", "left_semi")
