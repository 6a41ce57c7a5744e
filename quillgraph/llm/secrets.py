"""Secrets in texts: patterns propose candidates, a random forest removes the false ones.

A candidate is a token that some pattern takes for a credential. The forest sees its length, how its characters
follow each other, how much of it a dictionary covers, whether it stands in a path or an address, and the words beside
it, and tells credentials from hashes, numbers, identifiers and placeholders. The dictionary is counted over all texts:
their `VOCABULARY` most frequent words. The forest is trained here, on labelled findings that `labelled` makes from a
seed and that dictionary: at most `FINDINGS`, so the driver's work doesn't depend on the data. Scanning is one pass over
whole texts; only counts of words are shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, table

#: A private key: white space or escaped line ends, headers, then all up to its END line. Of a key without one, its lines
#: of base64, and a short last line that is padded, ends the text or the quotes, or has other characters than letters.
_BEGIN, _END = (rf"-----{x} [A-Z ]{{0,20}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
_SPACE = r"(?:\s|\\+[nrt])"
_HEADER = r"[A-Za-z][A-Za-z0-9-]*+:(?:(?!\\+[nr])[^\r\n])*+"
_WHOLE = rf"(?:[A-Za-z0-9+/=]|{_SPACE})*+{_END}"
_TAIL = rf"(?:[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}+|(?=\s*\Z|\\*[\"']))|(?=[A-Za-z]*+[0-9+/])[A-Za-z0-9+/]{{1,15}}+(?=[\r\n]|\\+[nr]))"
_CUT = rf"[A-Za-z0-9+/]{{16,}}+={{0,2}}+(?:{_SPACE}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{_SPACE}++{_TAIL})?"
#: A character of a part of a web token. Runs of them are taken whole and a match begins where a run does, so no character is read again and again.
_PART = "[A-Za-z0-9_-]"
#: Candidates by kind. Group 1, if there is one, is the secret; the rest is its context.
PATTERNS = {
    "cloud_key": r"\b((?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16})\b",
    "service_token": r"\b((?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}))",
    "web_token": rf"(?<!{_PART})(?={_PART}++\.{_PART}{{8,}}+\.{_PART}{{8}})(?:{_PART}*?-)??(eyJ{_PART}{{8,}}+\.{_PART}{{8,}}+\.{_PART}{{8,}}+)",
    "private_key": rf"({_BEGIN}(?:{_SPACE}*+(?:{_HEADER}{_SPACE}++)*+(?:{_WHOLE}|{_CUT}))?)",
    "assigned": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*+(?::=|=>|=|:)\s*+[\"']?([^\s\"'<>,;]{6,}+)",
    "url_password": r"(?i)(?<=[a-z0-9+.-])://[^\s/:@]*+:([^\s/@]{3,}+)@",
    "opaque": r"(?<![A-Za-z0-9_+/=-])((?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+)(?![A-Za-z0-9_+/=-])",
}
_patterns = [(k, re.compile(p)) for k, p in PATTERNS.items()]
#: A text without one of these and without a long run has no candidate.
_hint = re.compile(r"(?i)AKIA|ASIA|AGPA|AIDA|AROA|gh[pousr]_|xox|sk-|sk_live|AIza|glpat|eyJ|PRIVATE KEY|pass|pwd|secret|token|key|auth|credential|://|[A-Za-z0-9+/_-]{20}")
WORDS_BESIDE = 3
THRESHOLD = 0.5
FINDINGS, TREES, DEPTH, SEED = 6_000, 40, 9, 11
#: Words of the dictionary, and how long they are.
VOCABULARY, SHORTEST, LONGEST = 20_000, 4, 12

SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access", "auth", "credential", "bearer", "login", "private", "key", "aws", "connect")
SAFE_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "revision", "build", "version", "etag", "integrity", "order", "isbn", "doi", "phone", "card", "example", "test", "dummy", "placeholder", "session", "file", "image", "css", "class")
#: Words of placeholders and identifiers, which every dictionary has.
BASE_WORDS = (
    "example|sample|dummy|test|your|my|here|change|changeme|placeholder|insert|replace|password|secret|token|value|string|true|false|null|none|default|user|admin|name|index|image|style|script|"
    "component|module|package|version|release|config|setting|service|server|client|request|response|handler|manager|factory|controller|message|error|table|column|value|return|function|public|private|"
    "static|header|footer|content|article|page|home|about|contact|search|login|account|profile|download|upload|file|path|folder|image|video|audio|date|time|year|month|week|number|count|total|first|last|next|"
    "the|and|for|with|from|this|that|have|not|are|was|all|can|one|two|three"
).split("|")


def dictionary(df: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> tuple[str, ...]:
    """The `size` most frequent words of SHORTEST to LONGEST letters in all texts, lower-cased; of equals the first by code point.

    A first look at how many words are how frequent, in quarters of powers of two, tells from which count on there are
    enough, so only little more than `size` words are sorted or leave their tasks.
    """
    found = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word")
    counts = table(df.select(found).filter(F.char_length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n")), "words")
    rank = F.floor(F.log2("n") * 4)
    left, least = size, -1
    for r in counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).orderBy(F.desc("rank")).collect():  # 256 rows at most
        left, least = left - r["n"], r["rank"]
        if left <= 0:
            break
    return tuple(sorted(r["word"] for r in counts.filter(rank >= least).orderBy(F.desc("n"), "word").limit(size).collect()))


class Words:
    """A dictionary that tells how much of a string its words cover, the longest first at each place."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = frozenset(words) | {w for w in BASE_WORDS if len(w) >= SHORTEST}

    def covered(self, low: str) -> float:
        at = total = 0
        while at < len(low) - SHORTEST + 1:
            size = next((k for k in range(LONGEST, SHORTEST - 1, -1) if low[at : at + k] in self.words), 0)
            total += size
            at += size or 1
        return total / max(1, len(low))


_classes = np.zeros(128, np.int64)
for _i, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/=_-.")):
    _classes[[ord(c) for c in _set]] = _i + 1
#: Letter pairs that words are made of.
COMMON_PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())

NAMES = ("length", "entropy", "lower", "upper", "digit", "mark", "changes", "longest_run", "distinct", "pairs", "vowels", "hex", "decimal", "dictionary", "in_path", "in_url", "secret_words", "safe_words", "quoted", "assigned", "known_prefix", "uuid", "repeats", "times_40", "times_32", "times_64")


def features(value: str, before: str, after: str, kind: str, words: Words) -> list[float]:
    n = max(1, len(value))
    codes = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    cls = _classes[np.minimum(codes, 127)]
    counts = np.bincount(codes, minlength=128)
    p = counts[counts > 0] / n
    change = int((np.diff(cls) != 0).sum())
    runs = np.flatnonzero(np.diff(np.concatenate([[-1], cls, [-1]])))
    low = value.lower()
    pairs = sum(low[i : i + 2] in COMMON_PAIRS for i in range(n - 1)) / max(1, n - 1)
    near = re.findall(r"[a-z0-9_-]+", before.lower())[-WORDS_BESIDE:]
    later = re.findall(r"[a-z0-9_-]+", after.lower())[:WORDS_BESIDE]
    path = bool(re.search(r"[/\\]\S*$", before)) or bool(re.match(r"\S*[/\\]|\.\w{1,5}\b", after)) or value.count("/") > 1
    hexa = bool(re.fullmatch(r"[0-9a-fA-F-]+", value))
    return [
        len(value), float(-(p * np.log2(p)).sum()), float((cls == 1).sum() / n), float((cls == 2).sum() / n), float((cls == 3).sum() / n), float((cls == 4).sum() / n),
        change / n, float(np.diff(runs).max()) if len(runs) > 1 else n, len(p) / n, pairs, sum(c in "aeiou" for c in low) / n, hexa, value.isdigit(),
        words.covered(low), path, bool(re.search(r"://\S*$", before)), sum(any(s in w for s in SECRET_WORDS) for w in near), sum(w in SAFE_WORDS for w in near + later),
        before[-1:] in "\"'" and before != "", bool(re.search(r"(?:=|:)\s*[\"']?$", before)), kind in ("cloud_key", "service_token", "web_token", "private_key"),
        bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low)), bool(re.search(r"(.)\1{4}", value)) or "xxx" in low, len(value) == 40, len(value) == 32, len(value) == 64,
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what a pattern takes for a secret, in order, without overlaps: an earlier kind wins."""
    if not _hint.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _patterns:
        new = []
        for m in pattern.finditer(text):
            a, b = m.span(1)
            # found is in order and without overlaps, so only its last one that begins before b can meet a
            k = bisect_left(found, (b,))
            if not k or found[k - 1][1] <= a:
                new.append((a, b, kind))
        if new:
            found = sorted(found + new)
    return found


def context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 48) : start], text[end : end + 48]


def labelled(n: int = FINDINGS, seed: int = SEED, words: tuple[str, ...] = ()) -> Iterator[tuple[str, int, int, str, int]]:
    """Labelled findings (text, start, end, kind, 1 for a secret), half of each label, drawn from a seed.

    Secrets are random strings in the forms that services give out; the others are digests, identifiers, file names,
    placeholders and plain words in the places where they appear. Their words are those of the dictionary, and syllables.
    """
    known = [*BASE_WORDS, *words]
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mixed = dig + "abcdef", low + up + dig
    pairs = sorted(COMMON_PAIRS)
    word = lambda: pick(known) if rng.integers(2) else "".join(pick(pairs) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    between = lambda a, b: int(rng.integers(a, b + 1))
    names = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "db_password")

    def secret() -> tuple[str, str, str]:
        k = int(rng.integers(10))
        if k == 8:
            end, kind = pick(("\n", "\n", "\\n", "\\r\\n")), pick(("", "RSA ", "EC ", "ENCRYPTED "))
            head = pick(("", "", f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,{draw(dig + 'ABCDEF', 32)}{end}{end}"))
            body = end.join(draw(mixed + "+/", 64) for _ in range(between(1, 12)))
            return f"{prose(1)} {pick(('', '"', '"key": "'))}", f"-----BEGIN {kind}PRIVATE KEY-----{end}{head}{body}{end}" + pick(("", f"-----END {kind}PRIVATE KEY-----")), f"{pick((end, '"'))}{prose(1)}"
        if k == 9:
            value = draw(pick((mixed, mixed, mixed + "+/", hexa)), between(64, 600))
            if rng.integers(2):
                return f"{pick(('postgres', 'mysql', 'https', 'amqp'))}://{word()}:", value.replace("/", "+"), f"@{word()}.example.com/{word()}"
            return f"{prose(2)} {pick(names)}{pick(('=', ': ', ' = ', '=' + chr(34)))}", value, f" {prose(2)}"
        if k == 0:
            return f"{prose(3)} ", pick(("AKIA", "ASIA", "AROA")) + draw(up + dig, 16), f" {prose(2)}"
        if k == 1:
            return f"{prose(2)} {pick(names)} = \"", draw(hexa, pick((32, 40, 64))), f"\" {prose(2)}"
        if k == 2:
            return f"{prose(2)} {pick(names)}{pick(('=', ': ', ' = '))}", draw(pick((hexa, mixed, low + dig)), between(10, 40)), f" {prose(2)}"
        if k == 3:
            return f"{prose(1)} ", pick(("ghp_", "gho_", "sk_live_", "sk-", "glpat-")) + draw(mixed, between(36, 48)), f"{pick((' ', chr(10), ''))}{prose(1)}"
        if k == 4:
            return f"{prose(1)} Authorization: Bearer ", f"eyJ{draw(mixed, between(12, 30))}.{draw(mixed, between(20, 60))}.{draw(mixed, 43)}", f"\n{prose(1)}"
        if k == 5:
            return f"{pick(('postgres', 'mysql', 'https', 'amqp'))}://{word()}:", draw(mixed + "!#%", between(8, 24)), f"@{word()}.example.com/{word()}"
        if k == 6:
            return f"{prose(1)} {pick(names)}: ", word().title() + draw(dig, between(2, 4)) + pick("!#$%") + draw(mixed, between(2, 6)), f" {prose(2)}"
        return f"{pick(('AWS secret', 'secret key', 'login', 'credentials', 'the password is', 'access'))} ", draw(mixed + "+/", 40), f" {prose(2)}"

    def other() -> tuple[str, str, str]:
        k = int(rng.integers(11))
        if k == 10:
            return f"{prose(1)} {pick(('src', 'href', 'content'))}=\"data:{pick(('image/png', 'font/woff2'))};base64,", draw(mixed + "+/", between(64, 600)), f"\" {prose(1)}"
        if k == 0:
            return f"{prose(2)} {pick(('commit', 'sha1', 'revision', 'merge', 'build'))} ", draw(hexa, 40), f" {prose(2)}"
        if k == 1:
            return f"{pick(('md5', 'sha256', 'checksum', 'digest', 'hash', 'etag'))}{pick((': ', '=', ' '))}", draw(hexa, pick((32, 64))), f"  {word()}.{pick(('zip', 'tar', 'iso'))}"
        if k == 2:
            return f"{pick(('id', 'uuid', 'session', 'request'))} ", f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", f" {prose(1)}"
        if k == 3:
            return f"{prose(1)} {pick(names)}{pick(('=', ': ', ' = '))}", pick(("your-password-here", "changeme", "YOUR_API_KEY_HERE", "example-token", "<password>", "xxxxxxxxxxxxxxxx", "********", "placeholder_value", "my_secret_value", "none_default", "${DB_PASSWORD}", "os.environ", "getpass()", "request.form")), f" {prose(2)}"
        if k == 4:
            return f"{prose(2)} {pick(names)}{pick((': ', ' = '))}", word() + word(), f" {prose(3)}"
        if k == 5:
            return f"https://{word()}.example.com/{word()}/", f"{word()}-{word()}-{word()}-{draw(dig, between(4, 9))}", f"{pick(('.html', '/', '?page=2'))} {prose(1)}"
        if k == 6:
            return f"{pick(('src/', 'assets/', '/usr/lib/', 'img/'))}", f"{word()}_{word()}_{word()}_{draw(hexa, 8)}{draw(dig, 4)}", f".{pick(('js', 'css', 'png'))} {prose(1)}"
        if k == 7:
            return f"{prose(2)} ", f"{pick(known)}{pick(known).title()}{pick(known).title()}{pick(known).title()}{draw(dig, between(1, 3))}", f"{pick(('(', ' ', '.'))}{prose(1)}"
        if k == 8:
            return f"{prose(2)} ", f"{word()}-{word()}-{draw(dig, 4)}-{word()}-{word()}-{word()}", f" {prose(2)}"
        return f"{prose(1)} {pick(('data', 'image', 'integrity', 'src'))}=\"{pick(('sha384-', 'data/png/', 'base64/'))}", draw(mixed + "+/", between(40, 120)), f"\" {prose(1)}"

    for i in range(n):
        before, value, after = (secret, other)[i % 2]()
        text = before + value + after
        found = [c for c in candidates(text) if c[0] < len(before) + len(value) and len(before) < c[1]]
        start, end, kind = found[0] if found else (len(before), len(before) + len(value), "opaque")
        yield text, start, end, kind, 1 - i % 2


class Forest:
    """Trees of Gini splits on bootstrap samples, each split from a random few of the features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        self.nodes = []
        for _ in range(self.trees):
            rows, tree = rng.integers(0, len(x), len(x)), []
            self._grow(tree, x[rows], y[rows], self.depth, rng)
            self.nodes.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
        return self

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        me, share = len(tree), float(y.mean())
        tree.append((-1, 0.0, me, me, share))
        if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        whole = 2 * share * (1 - share)
        for f in rng.permutation(x.shape[1])[: int(math.sqrt(x.shape[1])) + 1]:
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(cut):
                left, right = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(y) - cut)
                gain = whole - (cut * 2 * left * (1 - left) + (len(y) - cut) * 2 * right * (1 - right)) / len(y)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            if low.all():
                return me
            a = self._grow(tree, x[low], y[low], depth - 1, rng)
            b = self._grow(tree, x[~low], y[~low], depth - 1, rng)
            tree[me] = (best[1], best[2], a, b, share)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            out += share[at]
        return out / len(self.nodes)


def matrix(found: list[tuple[str, int, int, str]], words: Words) -> np.ndarray:
    return np.array([features(t[a:b], *context(t, a, b), kind, words) for t, a, b, kind in found], np.float64).reshape(len(found), len(NAMES))


class Detector:
    """The trained forest and its dictionary."""

    def __init__(self, words: tuple[str, ...] = (), n: int = FINDINGS, seed: int = SEED):
        self.words = Words(words)
        rows = list(labelled(n, seed, words))
        self.forest = Forest(seed=seed).fit(matrix([r[:4] for r in rows], self.words), np.array([r[4] for r in rows], np.float64))

    def score(self, found: list[tuple[str, int, int, str]]) -> np.ndarray:
        """The forest's score of each finding (text, start, end, kind)."""
        return self.forest.score(matrix(found, self.words))


@lru_cache(4)
def trained(words: tuple[str, ...] = ()) -> Detector:
    return Detector(words)


def scan(texts: list[str | None], detector: Detector, threshold: float) -> list[list[tuple[int, int, str, float, bool]]]:
    """(start, end, kind, score, is a secret) of each candidate of each text."""
    spots = [candidates(t or "") for t in texts]
    flat = [(texts[i], *c) for i, own in enumerate(spots) for c in own]
    scores = iter(detector.score(flat).tolist()) if flat else iter(())
    return [[(a, b, kind, s := next(scores), s >= threshold) for a, b, kind in own] for own in spots]


FINDING = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_candidates, n_secrets, findings): one row for each row of df, texts without candidates included.

    A finding is a candidate with its place in code points, its kind, the forest's score and whether it counts as a
    secret. Null and empty texts have none; equal texts have equal findings. Ids may be null or repeat; other columns of
    df don't matter. An empty table gives an empty one.
    """
    detector, kind = trained(dictionary(df, text_col)), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = scan(batch.column(1).to_pylist(), detector, threshold)
            rows = [[dict(zip(("start", "end", "kind", "score", "secret"), x, strict=True)) for x in own] for own in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, rows)), pa.int64()), pa.array([sum(x["secret"] for x in own) for own in rows], pa.int64()), pa.array(rows, pa.list_(FINDING))],
                names=[id_col, "n_candidates", "n_secrets", "findings"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_candidates long, n_secrets long, findings array<struct<start:long,end:long,kind:string,score:double,secret:boolean>>")


def redacted(text: str, found: list[tuple[int, int, str, float, bool]]) -> str:
    out, at = [], 0
    for start, end, kind, _, secret in found:
        if secret:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of df, with each secret in the text replaced by its kind.

    The context of a secret, such as a name before an equals sign, stays. n_chars, if there is one, follows the text.
    Null texts stay null; rows need no key, each is scanned by itself.
    """
    detector, at, names = trained(dictionary(df, text_col)), df.columns.index(text_col), df.columns
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redacted(t, own) for t, own in zip(texts, scan(texts, detector, threshold), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if size is not None:
                changed = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), texts, clean, strict=True)]
                columns[size] = pa.array(changed, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
