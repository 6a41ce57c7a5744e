"""Ranked lexical search by inverted treaps.

Documents are counted once: each row's terms with their numbers of occurrences, as far as any question may ask for them
(a bitmap of at most 1 MB decides), and its length. Tasks then take the counted rows a segment at a time. In a segment
every term has a treap: its search order is that of the document ids, its heap order that of the impacts, so the root
of a subtree has the largest impact of all documents in it. A question walks the treaps of its terms at the same time:
a range of documents carries one subtree for each term, the sum of their roots' weighted impacts bounds the score of
every document of the range, and a range whose bound can't reach the k-th best score so far is dropped. Others are cut
at the document of their largest root; ranges of few documents are scored as they are. A task keeps the best k of a
question over all its segments, so later ones are pruned by what earlier ones found, and only those leave the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, for_texts, small, table

#: Postings and documents of a segment: what a task holds at once, besides one document that has more.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 19, 1 << 16
#: Terms of a block of questions, all of which a task knows; a question with more is a block of its own.
BLOCK_TERMS = 200_000
#: Documents of a range that is scored without being cut further.
LEAF = 64
#: The best of an item come together in so many parts first.
PARTS = 64

#: Bytes of UTF-8 that no term has become blanks, A-Z small letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and all beyond ASCII, A-Z lower-cased; none of a null text."""
    return (text or "").encode().translate(_FOLD).split()


def _slot(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - FILTER_BITS)


def _filter_of(asked: DataFrame) -> np.ndarray:
    """The bitmap of the slots in asked, as bytes: 2**FILTER_BITS bits whatever the input."""
    word, bit = F.expr("slot div 64"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in asked.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():  # 2**17 rows at most
        words[r["at"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _counted(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(bits, np.uint8)
        for batch in small(batches):
            sizes, ends, found, often = [], [0], [], []
            for x in batch.column(1):
                words = terms(x.as_py())
                sizes.append(len(words))
                for term, n in Counter(words).items():
                    slot = _slot(term)
                    if asked[slot >> 3] >> (slot & 7) & 1:
                        found.append(term)
                        often.append(n)
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(found, pa.binary()).cast(pa.string()), pa.array(often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "often"])

    return run


def _questions(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for id_, text in zip(batch.column(0), batch.column(1)):
                own = sorted(set(terms(text.as_py())))
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_.as_py()] * len(own), batch.column(0).type), pa.array(own, pa.binary()).cast(pa.string()), pa.array(list(map(_slot, own)), pa.int64())], names=["item", "term", "slot"]
                    )

    return run, f"item {kind}, term string, slot long"


class Segment:
    """The treaps of some rows' terms; doc is a row's place in the order of ids."""

    def __init__(self, rows: pa.Table, vocabulary: pa.Array, docs: int, length: int):
        """rows: (id, n, terms, often). docs and length are N and L of the whole table."""
        order = pc.sort_indices(rows.column("id"), null_placement="at_end")
        rows = rows.take(order).combine_chunks()
        self.ids, self.size = rows.column("id"), rows.num_rows
        of = lambda c: rows.column(c).chunk(0) if rows.column(c).num_chunks else pa.array([], rows.schema.field(c).type)
        which = pc.index_in(of("terms").flatten(), value_set=vocabulary)
        doc = np.repeat(np.arange(self.size), pc.list_value_length(of("terms")).to_numpy(zero_copy_only=False))
        known = which.is_valid().to_numpy(zero_copy_only=False)
        term = which.fill_null(-1).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        doc, often = doc[known], of("often").flatten().to_numpy(zero_copy_only=False)[known]
        n = of("n").to_numpy(zero_copy_only=False)
        key = term * self.size + doc
        order = np.argsort(key)
        self.key, term, doc, often = key[order], term[order], doc[order], often[order]
        mass = 50 + (50 * n * docs) // max(1, length)
        impact = (1_000_000_000 * often) // (1000 * often + 20 * mass[doc])
        self._grow(term, doc, impact)

    def _grow(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        """One treap for each term, in one pass over postings in order; equal impacts stand in a random, fixed order."""
        n = len(doc)
        shuffled = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        heap = ((impact << 20) | shuffled.astype(np.int64)).tolist()
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.terms, self.first = term[first], first
        left, right, roots, ends = [n] * n, [n] * n, [], [*first[1:].tolist(), n]
        for a, b in zip(first.tolist(), ends):
            stack: list[int] = []
            for i in range(a, b):
                last, h = n, heap[i]
                while stack and heap[stack[-1]] < h:
                    last = stack.pop()
                left[i] = last
                if stack:
                    right[stack[-1]] = i
                stack.append(i)
            roots.append(stack[0])
        # node n is none: no child, no impact
        self.left, self.right = (np.array([*x, n], np.int64) for x in (left, right))
        self.doc, self.impact, self.none = np.append(doc, -1), np.append(impact, 0), n
        self.root = dict(zip(self.terms.tolist(), roots))

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each subtree the root of what lies in [low, high)."""
        node = node.copy()
        todo = np.arange(len(node))
        while len(todo):
            at = node[todo]
            d = self.doc[at]
            over, under = (at != self.none) & (d >= high[todo]), (at != self.none) & (d < low[todo])
            node[todo[over]], node[todo[under]] = self.left[at[over]], self.right[at[under]]
            todo = todo[over | under]
        return node

    def _scores(self, range_: np.ndarray, low: np.ndarray, high: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, score) of all documents with a term in the given disjoint ranges; entries are (range, term)."""
        a, b = np.searchsorted(self.key, term * self.size + low), np.searchsorted(self.key, term * self.size + high)
        size = b - a
        of = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + a[of]
        place = range_[of] * LEAF + self.doc[at] - low[of]
        score = np.zeros(n * LEAF, np.int64)
        part = weight[of] * self.impact[at]
        if len(part) and float(part.max()) * len(part) < 2.0**53:
            score += np.bincount(place, weights=part, minlength=n * LEAF).astype(np.int64)  # exact below 2**53
        else:
            np.add.at(score, place, part)
        hit = np.flatnonzero(score)
        start = np.zeros(n, np.int64)
        start[range_] = low
        return start[hit // LEAF] + hit % LEAF, score[hit]

    def search(self, question: list[tuple[int, int]], best: "Best") -> None:
        """Walk the treaps of a question's (term, weight) together; what can be among the best is put there."""
        own = [(self.root[t], t, w) for t, w in question if t in self.root]
        if not own:
            return
        node, term, weight = (np.array(x, np.int64) for x in zip(*own))
        row, low, high = np.zeros(len(own), np.int64), np.array([0]), np.array([self.size])
        leaves: list[tuple] = []
        while len(low):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            value = weight * self.impact[node]
            bound = np.add.reduceat(value, starts)
            alive = bound >= best.least
            narrow = alive & (high - low <= LEAF)
            if narrow.any():
                mine = narrow[row]
                leaves.append((bound[narrow], low[narrow], high[narrow], np.cumsum(narrow)[row[mine]] - 1, term[mine], weight[mine]))
            wide = alive & ~narrow
            if not wide.any():
                break
            mine = wide[row]
            top = np.maximum.reduceat(value, starts)
            at_top = np.flatnonzero(value == top[row])
            cut = self.doc[node[at_top[np.unique(row[at_top], return_index=True)[1]]]][wide]
            row, node, term, weight = np.cumsum(wide)[row[mine]] - 1, node[mine], term[mine], weight[mine]
            low, high, n = low[wide], high[wide], int(wide.sum())
            # the document at the cut is scored now, which raises the least score early
            best.add(self, *self._scores(row, cut[row], cut[row] + 1, term, weight, n))
            node = self._within(np.tile(node, 2), np.concatenate([low[row], cut[row] + 1]), np.concatenate([cut[row], high[row]]))
            row, term, weight = np.concatenate([row, row + n]), np.tile(term, 2), np.tile(weight, 2)
            low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])
            there = node != self.none
            row, node, term, weight = row[there], node[there], term[there], weight[there]
            left, row = np.unique(row, return_inverse=True)
            low, high = low[left], high[left]
        self._finish(leaves, best)

    def _finish(self, leaves: list[tuple], best: "Best") -> None:
        """Score narrow ranges, those with the highest bounds first, as long as they can matter."""
        if not leaves:
            return
        before = np.cumsum([0, *(len(x[0]) for x in leaves)])
        bound, low, high = (np.concatenate([x[i] for x in leaves]) for i in range(3))
        range_ = np.concatenate([x[3] + n for x, n in zip(leaves, before)])
        term, weight = (np.concatenate([x[i] for x in leaves]) for i in (4, 5))
        rank = np.empty(len(bound), np.int64)
        rank[np.argsort(-bound, kind="stable")] = np.arange(len(bound))
        order = np.argsort(rank[range_], kind="stable")
        place, term, weight = rank[range_][order], term[order], weight[order]
        by_rank = np.argsort(rank)
        bound, low, high = bound[by_rank], low[by_rank], high[by_rank]
        at, step = 0, 16
        while at < len(bound) and bound[at] >= best.least:
            end = min(len(bound), at + step)
            a, b = np.searchsorted(place, [at, end])
            own = place[a:b]
            best.add(self, *self._scores(own - at, low[own], high[own], term[a:b], weight[a:b], end - at))
            at, step = end, step * 2


class Best:
    """The k best documents of a question so far, equal scores by ascending id, nulls last."""

    def __init__(self, k: int):
        self.k, self.least, self.rows = k, 1, []

    def add(self, segment: Segment, doc: np.ndarray, score: np.ndarray) -> None:
        can = score >= self.least
        if not can.any():
            return
        doc, score = doc[can], score[can]
        first = np.lexsort((doc, -score))[: self.k]
        new = []
        for d, s in zip(doc[first].tolist(), score[first].tolist()):
            id_ = segment.ids[d].as_py()
            new.append((-s, id_ is None, id_))
        self.rows = sorted([*self.rows, *new], key=lambda x: x if x[2] is not None else (x[0], True, 0))[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The counted rows of a task, as many at a time as a segment may have."""
    held, docs, postings = [], 0, 0
    for batch in small(batches):
        held.append(batch)
        docs += batch.num_rows
        postings += len(batch.column(2).flatten())
        if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
            yield pa.Table.from_batches(held)
            held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search(block: list[tuple], k: int, docs: int, length: int):
    """Rows of (item number, id, score): the best k of each item in a task's rows."""
    numbers: dict[str, int] = {}
    items: dict = {}
    for item, term, weight in block:
        items.setdefault(item, []).append((numbers.setdefault(term, len(numbers)), weight))
    names, asks, vocabulary = list(items), list(items.values()), list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asks]
        known = pa.array(vocabulary, pa.string())
        for rows in segments(batches):
            segment = Segment(rows, known, docs, length)
            for question, b in zip(asks, best):
                segment.search(question, b)
            kind = segment.ids.type
        found = [(i, r[2], -r[0]) for i, b in enumerate(best) for r in b.rows]
        if found:
            number, id_, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(id_, kind), pa.array(score, pa.int64())], names=["number", "doc", "score"])

    return run, names


def _blocks(asked: DataFrame, most: int) -> tuple[DataFrame, int]:
    """asked with a number of its block, and how many there are: no block has more than `most` rows, unless it is one item's."""
    n = max(1, -(-2 * asked.count() // most))
    while True:
        numbered = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
        whole = numbered.groupBy("block").agg(F.count("*").alias("rows"), F.approx_count_distinct("item").alias("items"))
        if whole.filter((F.col("rows") > most) & (F.col("items") > 1)).isEmpty():
            return numbered, n
        n *= 2


def best_of(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each item, found in parts first, with their rank."""
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS))
    some = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents that score highest, above 0.

    Every row of docs is a document, also where ids or whole rows repeat or an id is null; null ids come last among
    equal scores. Rows of items with the same id are one item with the terms of all of them; a null id is one, too. A
    null or empty text has no terms: such documents are no hits and don't count, such items have no rows. Empty tables
    give no rows. Extra columns don't matter.

    Questions are taken in blocks of bounded size against all rows. Rows aren't grouped by terms, so frequent terms
    load no task; frequencies are counted in each task before they are shuffled.
    """
    spark = docs.sparkSession
    for_texts(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    run, schema = _questions(item_kind)
    questions = table(items.select(item_col, question_col).mapInArrow(run, schema).groupBy("item", "term").agg(F.first("slot").alias("slot")), "questions")
    bits = np.packbits(_filter_of(questions), bitorder="little").tobytes()
    seen = Observation()
    counted = table(
        docs.select(id_col, text_col).mapInArrow(_counted(bits), f"id {kind}, n long, terms array<string>, often array<long>"), "counted",
        seen, F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"),
    )
    n_docs, length = seen.get["docs"], seen.get["length"]
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    asked, n_blocks = _blocks(table(questions.join(held, "term").select("item", "term", weight.alias("weight")).filter("weight > 0"), "asked"), block_terms)
    hits = None
    for b in range(n_blocks):
        block = sorted((tuple(r) for r in asked.filter(F.col("block") == b).select("item", "term", "weight").collect()), key=repr)
        run, names = _search(block, k, n_docs, length)
        named = spark.createDataFrame(list(enumerate(names)), f"number long, item {item_kind}")
        found = counted.mapInArrow(run, f"number long, doc {kind}, score long").join(F.broadcast(named), "number").drop("number")
        found = table(found, "hits") if n_blocks > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    ranked = best_of(hits, k, F.desc("score"), F.asc_nulls_last("doc"))
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
