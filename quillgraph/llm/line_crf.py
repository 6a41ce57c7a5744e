"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The field sees a line's own features and those of its neighbours, and how labels follow each
other; forward and backward sums give each line's probability to be good, and a document's score is the share of its
text in good lines, weighted by length and calibrated to the labels of documents.

Only documents are labelled, so lines get their labels in two steps: a line model is fitted with each line labelled as
its document, then lines of bad documents that it holds to be good are relabelled, and the field is fitted on that. The
fit takes at most `SAMPLE` labelled documents and a window of `WINDOW` lines of each, drawn by hashes; a window's features
are of fixed size, so what reaches the driver has a bound in bytes, too. Scores are one pass over whole texts, and
neither labels nor a document's id, language or source are inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, table

#: Labelled documents of the fit, half of each label if there are so many, and lines of each.
SAMPLE, WINDOW = 2_400, 32
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 120, 0.1, 1e-4
#: Lines whose features are held at once where a text is scored.
CHUNK_LINES = 50_000

_mark = re.compile(r"[^\w\s]|_")
_repeat = re.compile(r"([^\w\s]|_)\1")
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_digit = re.compile(r"[0-9]")
_code = re.compile(r"[{}<>\\=;~^`|#$%&*+]")
_vowel = re.compile(r"[aeiouyà-æè-ïò-öù-ýAEIOUYÀ-ÆÈ-ÏÒ-ÖÙ-Ý]")
_end = re.compile(r"[.!?…:;\"'»)]\Z")
_link = re.compile(r"://|www\.|@|\bhttp", re.IGNORECASE)
_opening = re.compile(r"[\"'«(¿¡-]*[A-ZÀ-ÖØ-Þ0-9]")

NAMES = (
    "empty", "short", "words", "characters", "word_length", "long_word", "marks", "marks_alone", "marks_trailing", "marks_repeated", "code_marks", "digits", "capitals", "shouted",
    "vowels", "distinct", "commonest", "same_as_next", "ends_as_sentence", "begins_as_sentence", "link", "seen_before",
)


def line_features(line: str, seen: bool) -> tuple[float, ...]:
    """Shares and sizes of one line, each from 0 to 1, in time that its length bounds."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (1.0,) + (0.0,) * (len(NAMES) - 2) + (float(seen),)
    inked = sum(map(len, words))
    share = lambda pattern: len(pattern.findall(line)) / inked
    has_marks = _mark.search(line) is not None
    alone = sum(1 for w in words if len(w) <= 2 and not w.isalnum()) if has_marks else 0
    trailing = sum(1 for w in words if len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum()) if has_marks else 0
    counts = Counter(words)
    return (
        0.0, float(n < 5), min(1.0, math.log1p(n) / 8), min(1.0, math.log1p(size) / 12), min(1.0, inked / n / 20), min(1.0, math.log1p(max(map(len, words))) / 8),
        share(_mark) if has_marks else 0.0, alone / n, trailing / n, share(_repeat) if has_marks else 0.0, share(_code) if has_marks else 0.0,
        share(_digit), share(_upper), sum(1 for w in words if len(w) > 1 and w.isupper()) / n, share(_vowel), len(counts) / n, max(counts.values()) / n if n > 3 else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n, float(_end.search(words[-1]) is not None), float(_opening.match(words[0]) is not None), float(_link.search(line) is not None), float(seen),
    )


def lines_of(text: str | None) -> list[str]:
    """A null or empty text is one empty line."""
    return (text or "").split("\n")


def own_features(lines: list[str], seen: set[int] | None = None) -> np.ndarray:
    """(lines, features) and, with a set, whether a line was there before."""
    seen = set() if seen is None else seen
    rows = []
    for line in lines:
        h = hash(line)
        rows.append(line_features(line, h in seen and bool(line)))
        seen.add(h)
    return np.array(rows, np.float32).reshape(len(lines), len(NAMES))


def with_neighbours(own: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """What the field sees of each line: its own features, their square roots, those of the lines beside it, and whether there are such.

    before and after are the lines beside own where it is a part of a document.
    """
    none = np.zeros((1, own.shape[1]), np.float32)
    up = np.concatenate([none if before is None else before[None], own[:-1]])
    down = np.concatenate([own[1:], none if after is None else after[None]])
    edges = np.zeros((len(own), 3), np.float32)
    edges[:, 2] = 1
    edges[0, 0], edges[-1, 1] = before is None, after is None
    return np.concatenate([own, np.sqrt(own), up, down, edges], axis=1)


def marginals(node: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each line's probability to be good by forward and backward sums.

    node is the log weight of good against bad of each line, trans[a, b] that of label b (0 bad, 1 good) after a.
    """
    n = len(node)
    if n == 1:
        return 1 / (1 + np.exp(-np.clip(node, -500, 500)))
    (bb, bg), (gb, gg) = trans.tolist()
    x = node.tolist()

    def step(d: float, to: tuple[float, float, float, float]) -> float:
        """Log odds of the next line's sums from those of this one."""
        fb, fg, tb, tg = to
        top, low = (d + tg, fg) if d + tg > fg else (fg, d + tg)
        good = top + math.log1p(math.exp(low - top))
        top, low = (d + tb, fb) if d + tb > fb else (fb, d + tb)
        return good - top - math.log1p(math.exp(low - top))

    forward, d = [x[0]], x[0]
    for v in x[1:]:
        d = step(d, (bb, bg, gb, gg)) + v
        forward.append(d)
    backward, d = [0.0], 0.0
    for v in reversed(x[1:]):
        d = step(d + v, (bb, gb, bg, gg))
        backward.append(d)
    total = np.array(forward) + np.array(backward[::-1])
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def chain_sums(node: np.ndarray, there: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition, marginals of good, expected pairs of labels) of chains padded to one length.

    node: (chains, length), there: which places are lines, each chain's first ones.
    """
    c, n = node.shape
    score = np.stack([np.zeros_like(node), node], axis=2)
    forward, backward = np.zeros((n, c, 2)), np.zeros((n, c, 2))
    forward[0] = score[:, 0]
    for i in range(1, n):
        new = np.logaddexp(forward[i - 1][:, :1] + trans[0], forward[i - 1][:, 1:] + trans[1]) + score[:, i]
        forward[i] = np.where(there[:, i, None], new, forward[i - 1])
    log_z = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
    for i in range(n - 2, -1, -1):
        ahead = backward[i + 1] + score[:, i + 1]
        new = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
        backward[i] = np.where(there[:, i + 1, None], new, 0.0)
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z).T * there
    pairs = np.zeros((c, 2, 2))
    for i in range(1, n):
        joint = forward[i - 1][:, :, None] + trans + (backward[i] + score[:, i])[:, None, :] - log_z[:, None, None]
        pairs += np.exp(joint) * there[:, i, None, None]
    return log_z, good, pairs


def _climb(weights: np.ndarray, gradient, steps: int = STEPS) -> np.ndarray:
    """Adam: steps along gradients, scaled by their own size."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def crf_gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray, by: np.ndarray) -> tuple[float, np.ndarray]:
    """(log likelihood, its gradient) of chains with labels y, each chain weighted by `by`; the last four weights are the transitions."""
    w, trans = weights[:-4], weights[-4:].reshape(2, 2)
    log_z, good, pairs = chain_sums(x @ w, there, trans)
    seen = np.zeros_like(pairs)
    both = there[:, 1:] & there[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            seen[:, a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum(axis=1)
    of_y = ((x @ w) * y * there).sum(axis=1) + (seen * trans).sum(axis=(1, 2))
    rest = (y - good) * there * by[:, None]
    return float(((of_y - log_z) * by).sum()), np.concatenate([np.einsum("cn,cnf->f", rest, x), ((seen - pairs) * by[:, None, None]).sum(axis=0).ravel()])


@dataclass(frozen=True)
class LineField:
    """Weights of what the field sees, transitions, and the calibration from a document's log odds to its score."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, chains: list[tuple[np.ndarray, np.ndarray, int]], share_good: float) -> LineField:
        """chains: what is seen of the lines (lines, features), their lengths, the document's label. share_good: of all labelled documents.

        With one label only, all scores are that label's.
        """
        width = 4 * len(NAMES) + 3
        labels = np.array([c[2] for c in chains], np.int64)
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(width), np.zeros((2, 2)), 0.0, 6.0 if labels.sum() else (-6.0 if len(labels) else 0.0))
        longest = max(len(c[0]) for c in chains)
        x = np.zeros((len(chains), longest, width))
        size = np.zeros((len(chains), longest))
        there = np.zeros((len(chains), longest), bool)
        for i, (seen, length, _) in enumerate(chains):
            x[i, : len(seen)], size[i, : len(seen)], there[i, : len(seen)] = seen, length, True
        # each document counts once, and the two labels as among all labelled documents
        by = np.where(labels == 1, share_good / labels.mean(), (1 - share_good) / (1 - labels.mean())) / len(chains)
        y = np.where(there, labels[:, None], 0)
        flat, each = x[there], (by / there.sum(axis=1))[:, None].repeat(longest, 1)[there]
        alone = _climb(np.zeros(width), lambda w: flat.T @ ((y[there] - _sigmoid(flat @ w)) * each) - RIDGE * w)
        good = np.zeros_like(y)
        good[there] = flat @ alone > 0
        # a bad document with no line that looks bad stays bad as a whole
        mixed = (labels == 0) & ((good == 0) & there).any(axis=1)
        y[mixed] = good[mixed]
        by_line = by / there.sum(axis=1)
        both = _climb(np.append(alone, np.zeros(4)), lambda w: crf_gradient(w, x, y, there, by_line)[1] - RIDGE * w)
        found = cls(both[:-4], both[-4:].reshape(2, 2))
        odds = np.array([found.odds(marginals(seen @ found.weights, found.trans), length) for seen, length, _ in chains])
        line = np.stack([odds, np.ones_like(odds)], axis=1)
        slope, shift = _climb(np.array([1.0, 0.0]), lambda w: line.T @ ((labels - _sigmoid(line @ w)) * by) - RIDGE * (w - (1, 0)), 400).tolist()
        return cls(found.weights, found.trans, max(slope, 0.0), shift)

    @staticmethod
    def odds(good: np.ndarray, length: np.ndarray) -> float:
        """Log odds of the length-weighted share of good lines, from -7 to 7."""
        share = float((good * length).sum() / length.sum())
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share))

    def line_marginals(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good, length) of each line of a whole text; features are made a part at a time."""
        lines = lines_of(text)
        seen: set[int] = set()
        node, before, own = [], None, own_features(lines[:CHUNK_LINES], seen)
        for at in range(0, len(lines), CHUNK_LINES):
            later = own_features(lines[at + CHUNK_LINES : at + 2 * CHUNK_LINES], seen)
            node.append(with_neighbours(own, before, later[0] if len(later) else None) @ self.weights)
            before, own = own[-1], later
        return marginals(np.concatenate(node), self.trans), line_lengths(lines)

    def score(self, text: str | None) -> float:
        return float(_sigmoid(np.array(self.slope * self.odds(*self.line_marginals(text)) + self.shift)))


def line_lengths(lines: list[str]) -> np.ndarray:
    """The weight of each line: its characters, and one more, so that empty lines have some."""
    return np.array([len(x) + 1.0 for x in lines])


def held_out(id_: Column) -> Column:
    """Whether a document is kept from the fit: CRC-32 of its id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window of each text: where it begins is drawn by its hash."""
    for batch in small(batches):
        rows = []
        for text, draw in zip(batch.column(1), batch.column(2)):
            lines = lines_of(text.as_py())
            at = draw.as_py() % max(1, len(lines) - WINDOW + 1)
            own = own_features(lines[: at + WINDOW + 1])
            seen = with_neighbours(own, None, None)[at : at + WINDOW]
            rows.append((seen.astype(np.float32).tobytes(), line_lengths(lines[at : at + WINDOW]).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["id", "draw", "seen", "length"])


def fit_line_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LineField:
    """The field fitted on labelled documents that are not held out.

    Ids whose labels contradict each other, null labels and null ids aren't used. Half of the sample are ids of each
    label, those with the smallest hashes; of a document that repeats one row is used. The ids of the sample, at most
    `sample` rows, go to every task that reads documents.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
    clear = table(known.agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other").select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("draw")), "clear")
    of = {r["label"]: r["n"] for r in clear.groupBy("label").agg(F.count("*").alias("n")).collect()}
    halves = [clear.filter(F.col("label") == k).orderBy("draw", "id").limit(max(1, sample // 2)).select("id", "label") for k in (0, 1)]
    drawn = halves[0].unionByName(halves[1])
    draw = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), text_col, draw.alias("draw")).join(F.broadcast(drawn.select("id")), "id").select("id", text_col, "draw")
    windows = asked.mapInArrow(_windows, f"id {kind}, draw long, seen binary, length binary")
    one = windows.groupBy("id").agg(F.min_by(F.struct("seen", "length"), F.struct("draw", "seen")).alias("window")).join(F.broadcast(drawn), "id").orderBy("id")
    width = 4 * len(NAMES) + 3
    chains = [(np.frombuffer(r["window"]["seen"], np.float32).reshape(-1, width), np.frombuffer(r["window"]["length"]), r["label"]) for r in one.select("window", "label").collect()]
    return LineField.fit(chains, of.get(1, 0) / max(1, sum(of.values())))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, score, predicted, n_lines, bad_lines): a row for each row of docs.

    A null or empty text is one empty line, and gets the score of such. Ids may be null or repeat; equal texts get
    equal scores. Without labels every score is 0.5. bad_lines are those with a probability below one half of being
    good. Extra columns don't matter; nothing but the bounded sample of the fit is shuffled.
    """
    field = fit_line_field(docs, labels, id_col, text_col, sample=sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores, n, bad = [], [], []
            for text in batch.column(1):
                good, length = field.line_marginals(text.as_py())
                scores.append(float(_sigmoid(np.array(field.slope * field.odds(good, length) + field.shift))))
                n.append(len(good))
                bad.append(int((good < 0.5).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], names=["id", "score", "n_lines", "bad_lines"])

    found = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, n_lines long, bad_lines long")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "bad_lines")
