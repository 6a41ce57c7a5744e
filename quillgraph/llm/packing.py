"""Packing by concatenate and cut.

All documents form one line of tokens, cut into windows of equal length. The first pass tokenises each document once,
in its partition, and writes its tokens with the number of tokens before it in the partition. The sums of partitions,
one small row each, become offsets by a prefix sum; the second pass adds them and cuts each document where the line's
windows end, so that a document that crosses an end becomes a record on either side of it. Nothing but the partition
sums is shuffled, and only the last window has padding.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table

WINDOW = 1024
#: The id after each document.
END = 0


#: Texts on which the fast encoder has to agree before it is used.
PROBES = ("It's 12,345 words;  two\n\n spaces\tand tabs   ", "ünï 漢字 <|endoftext|> x<|endoftext|>", "")


@lru_cache(2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizers file at path.

    A byte-level BPE whose ranks lie beside its file is read by the library that takes a quarter of the time, if it
    gives the same ids on PROBES (tests compare more). Its pattern can't take very long runs of white space: texts that
    it refuses go to the tokenizers library, and so do all texts of other files.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return slow
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    if any(fast.encode(t, allowed_special="all") != slow(t) for t in PROBES):
        return slow

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return slow(text)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokens(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encode = _encoder(path)
        for batch in small(batches):
            ids, counts, starts = [], [], []
            for text in batch.column(1):
                own = [*encode(text.as_py() or ""), end]
                ids.append(np.array(own, "<u4").tobytes() if max(own) >= 1 << 16 else np.array(own, "<u2").tobytes())
                counts.append(len(own))
                starts.append(before)
                before += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["id", "part", "before", "n", "ids"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            row, out = [], []
            for i, (at, n, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    place = (at + start) % window
                    length = min(window - place, n - start)
                    row.append(i)
                    out.append((start, length, n, (at + start) // window, place, ids[start : start + length]))
                    start += length
            arrays = [pa.array([x[k] for x in out], pa.int64()) for k in range(5)]
            sums = pa.array([zlib.crc32(x[5].tobytes()) for x in out], pa.int64())
            flat = np.concatenate([x[5] for x in out]).astype(np.int32) if out else np.empty(0, np.int32)
            ends = np.cumsum([0, *(x[1] for x in out)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays, sums, ids], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(id_col, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids): the pieces of documents, at least one for each row of df.

    A document is the ids of its text and then `end`. A piece is its ids from `start` on; it lies at `offset` of
    sequence `sequence_id`; ids_crc32 is unsigned, over little-endian unsigned 32-bit ids. All sequences but the last are full, and the last is padded to `window` by whoever reads
    it. A null or empty text is its end alone. Ids of documents may be null, repeat
    and have any type; other columns of df don't matter. An empty table has no pieces.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    own = table(docs.mapInArrow(_tokens(tokenizer or default_tokenizer(), end), f"id {kind}, part int, before long, n long, ids binary"), "tokens")
    # one row for each partition of the first pass
    parts = own.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("sum"))
    offsets = parts.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part0"))
    placed = own.join(F.broadcast(offsets), "part").select("id", (F.col("part0") + F.col("before")).alias("at"), "n", "ids")
    pieces = placed.mapInArrow(_cut(window), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids array<int>")
    return pieces.withColumnRenamed("id", id_col)
