"""Line-first cleaning of web text.

Every line is judged by itself: does its punctuation look like prose (few words end in a doubled mark), is it navigation
(few marks stand alone), is it boilerplate, does it only repeat itself or shout. Failing lines are removed, and a document that loses too much of its text that way is
rejected. Before that, two base rules look at the document as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small

SYMBOL = r"[#*$%&|<>]"
#: A mark that stands alone between words, as in menus, breadcrumbs and tables: neither letter nor digit.
ALONE = r"[^\p{L}\p{N}]"
#: What a word may end in twice without being noise: letters, digits and dots.
PLAIN = r"[\p{L}\p{N}.]$"
#: A shouted word has two capitals and no small letter.
TWO_CAPITALS, SMALL_LETTER = r"\p{Lu}\P{Lu}*\p{Lu}", r"\p{Ll}"
LETTER = r"\p{L}"
BOILERPLATE = (
    r"\b(?:cookie policy|accept (?:all )?cookies|all rights reserved|terms of (?:use|service)|privacy policy|"
    r"subscribe to our|sign up for our|click here|read more|share this|follow us on|skip to (?:main )?content|"
    r"javascript is (?:disabled|required)|enable javascript|lorem ipsum|back to top|powered by)\b"
)

_symbol, _alone, _plain, _two_capitals, _small_letter, _letter = map(regex.compile, (SYMBOL, ALONE, PLAIN, TWO_CAPITALS, SMALL_LETTER, LETTER))
#: A line without this has no shouted word.
_capitals = regex.compile(r"\p{Lu}\S*\p{Lu}")
_boilerplate = re.compile(BOILERPLATE, re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class Limits:
    """A line fails from these shares of its words on; a document, if less than `keep` of its words' characters is left."""

    separators: float = 0.2
    trailing: float = 0.2
    one_word: float = 0.4
    shouting: float = 0.8
    long_line: int = 8
    keep: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def failing(line: str, words: list[str], limits: Limits) -> str | None:
    """The rule that a line with words fails, or None."""
    n = len(words)
    alone = [w for w in words if len(w) == 1]
    if len(alone) >= limits.separators * n and sum(map(bool, map(_alone.match, alone))) >= limits.separators * n:
        return "navigation"
    doubled = [w for w in words if w[-1] == w[-2:-1]]
    if len(doubled) >= limits.trailing * n and sum(1 for w in doubled if not _plain.search(w)) >= limits.trailing * n:
        return "punctuation"
    if n <= 20 and _boilerplate.search(line):
        return "boilerplate"
    if n >= limits.long_line:
        if max(Counter(words).values()) >= limits.one_word * n:
            return "repeated"
        if _capitals.search(line):
            letters = sum(1 for w in words if _letter.search(w))
            if letters and sum(1 for w in words if _two_capitals.search(w) and not _small_letter.search(w)) >= limits.shouting * letters:
                return "shouting"
    return None


def in_repeats(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) < 1 << 21:
        windows = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
    else:
        windows = np.unique(np.stack([at[:-2], at[1:-1], at[2:]]), axis=1, return_inverse=True)[1].reshape(-1)
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = (times > 1)[back.reshape(-1)]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def judge(text: str | None, limits: Limits = Limits()) -> tuple[dict, str]:
    """Figures and verdict of one text, and what is left of it."""
    text = text or ""
    found = text.encode().split()
    n, chars = len(found), sum(len(w.decode()) for w in found)
    seen: set[str] = set()
    left, dup, lost, n_failed = [], 0, 0, 0
    for line in text.split("\n"):
        own = [w.decode() for w in line.encode().split()]
        if own:
            dup += line in seen
            seen.add(line)
            if failing(line, own, limits):
                n_failed += 1
                lost += sum(map(len, own))
                continue
        left.append(line)
    repeats = in_repeats(found)
    base = n < limits.min_words or 100 * repeats > limits.repeat_percent * n
    figures = {
        "n_words": n, "word_chars": chars, "n_symbols": len(_symbol.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeats,
        "base_failed": base, "kept": not base and chars - lost >= limits.keep * chars, "n_failed_lines": n_failed, "lost_chars": lost,
    }
    return figures, "\n".join(left)


KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_failed_lines": pa.int64(), "lost_chars": pa.int64()}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), texts: bool = False) -> DataFrame:
    """One row for each row of df: id_col, the figures of SCHEMA and, with texts, what is left of the text.

    A null or empty text has no words and fails. Equal texts get equal verdicts. Ids may be null or repeat; other
    columns of df don't matter. One pass over the whole texts, nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [judge(t.as_py(), limits) for t in batch.column(1)]
            own = [batch.column(0), *(pa.array([r[k] for r, _ in rows], t) for k, t in KINDS.items())]
            if texts:
                own.append(pa.array([t for _, t in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(own, names=[id_col, *KINDS, *["cleaned"] * texts])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}{', cleaned string' if texts else ''}")


def clean_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of df whose text is kept, without the failing lines of their texts; all columns of df stay.

    A column n_chars, if there is one, follows the text. Rows need no key: each is judged by itself.
    """
    names = df.columns
    at = names.index(text_col)
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [judge(t.as_py(), limits) for t in batch.column(at)]
            keep = pa.array([r["kept"] for r, _ in rows], pa.bool_())
            columns = list(batch.columns)
            columns[at] = pa.array([t for _, t in rows], columns[at].type)
            if size is not None:
                columns[size] = pa.array([len(t) for _, t in rows], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return df.mapInArrow(run, df.schema)
