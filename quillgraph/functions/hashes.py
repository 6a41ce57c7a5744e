"""Fingerprints and hashes of texts, and distances between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: FNV-1a, 64 bits: fixed values of the published algorithm.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def _bits(feature: str, n: int) -> int:
    h = FNV_OFFSET
    for b in feature.encode():
        h = (h ^ b) * FNV_PRIME & MASK
    out = 0
    for i in range(n):
        out |= 1 << (h >> 8 * i & 63)
    return out


def _word_bits(word: str, memo: dict[str, int]) -> int:
    got = memo.get(word)
    if got is None:
        got = _bits("w:" + word, 3)
        if len(word.encode()) >= 4:
            got |= _bits("s:" + word[:4], 2)
        for i in range(len(word) - 2):
            got |= _bits("t:" + word[i : i + 3], 1)
        memo[word] = got
    return got


def fingerprint_of(text: str | None, memo: dict[str, int] | None = None) -> int:
    """A 64-bit Bloom filter of a text's words, their first four letters and their letter triples, as a signed number."""
    memo = {} if memo is None else memo
    kept = "".join(c.lower()[0] if c.isalnum() else " " if c.isspace() or c in "-_" else "" for c in text or "")
    out = 0
    for word in kept.split():
        out |= _word_bits(word, memo)
    return out - (1 << 64) if out >> 63 else out


@F.pandas_udf(LongType())
def text_fingerprint(texts: pd.Series) -> pd.Series:
    memo: dict[str, int] = {}
    return pd.Series(np.array([fingerprint_of(t, memo) for t in texts], np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors; the sum runs in the order of the elements, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def leaf_hash(kind: Column, text: Column) -> Column:
    """Identity of a block: its kind and its text."""
    return F.sha2(F.concat(kind, F.lit("\x00"), text), 256)


def combined_hash(hashes: Column) -> Column:
    """Identity of an ordered list of hashes; an empty one is null."""
    return F.when(F.size(hashes) > 0, F.sha2(F.concat_ws("\n", hashes), 256))


def normalize_rules(text: Column) -> Column:
    """A rule block without comments and needless white space, so that only its content counts."""
    bare = F.regexp_replace(text, r"(?m);[^\n]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\s*([()])\s*", "$1"))
