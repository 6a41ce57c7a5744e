"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: how likely the text's letter sequences are in each language, which
language the markup declares, which suffix the address has, and which languages the host's other pages are in. The
text model is fitted on a bounded sample of labelled rows (`SAMPLE`, of at most `LANGS` languages). Everything else is counted over all rows by
grouped sums: how often a declaration or a suffix goes with a language, and priors of hosts that lean on those of
their domain, which lean on the whole, the more the fewer pages there are. A page's own text is left out of its host's
counts, so it isn't heard twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, small, table

SAMPLE = 2_000
#: Labelled rows that a rare language has in the sample, if there are so many; languages that the model has at most, and parts in which its counts are added up.
LEAST, LANGS, SUMS = 50, 256, 4
#: Buckets of letter triples, and how much less a triple says because its neighbours say it too.
BUCKETS, TEMPER, SMOOTH = 1 << 15, 0.25, 0.5
#: Pages that a domain's, or a host's, higher level counts for.
LEAN = 4.0
CHUNK = 1 << 20

_lang = re.compile(r"(?is)\A<html\b.*?\blang\s*=\s*[\"']?([a-z]{2,3})")
_equiv = re.compile(r"(?is)\A<meta\b.*?content-language[\"']?\s+content\s*=\s*[\"']?([a-z]{2,3})")
_opens = re.compile(r"(?i)<(?:html|meta)\b")
_hides = re.compile(r"(?i)<(script|style|noscript|template)\b|<!--")
_ends = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
#: References to characters that there are not; their digits needn't be read as a number.
_beyond = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")


def _shown(page: str) -> Iterator[str]:
    """What lies outside scripts, styles and comments; an element that doesn't end hides nothing. One pass."""
    at, gone = 0, set()
    for m in _hides.finditer(page):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in gone:
            continue
        end = _ends[kind].search(page, m.end())
        if end is None:
            gone.add(kind)
            continue
        yield page[at : m.start()]
        at = end.end()
    yield page[at:]


def _untagged(text: str) -> Iterator[str]:
    """What lies outside tags; a < without a > after it is text."""
    at = 0
    while (i := text.find("<", at)) >= 0 and (j := text.find(">", i)) >= 0:
        yield text[at:i]
        at = j + 1
    yield text[at:]


def visible(page: str) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return html.unescape(_beyond.sub(" ", " ".join(_untagged(" ".join(_shown(page))))))


def declared(page: str) -> str:
    """The language that the first html or meta tag with one names, else empty."""
    at = 0
    while m := _opens.search(page, at):
        at = page.find(">", m.start())
        tag = page[m.start() : at if at >= 0 else len(page)]
        if found := _lang.match(tag) or _equiv.match(tag):
            return found[1].lower()
        if at < 0:
            break
    return ""


def triples(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte triples of a lower-cased text, a part at a time."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    for at in range(0, max(0, len(raw) - 2), CHUNK):
        b = raw[at : at + CHUNK + 2].astype(np.uint32)
        yield ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)).astype(np.int64)


def triple_counts(text: str) -> np.ndarray:
    """How often each bucket occurs: of one size whatever the text's."""
    return sum((np.bincount(codes, minlength=BUCKETS) for codes in triples(text)), np.zeros(BUCKETS, np.int64))


class TextModel:
    def __init__(self, langs: list[str], log: np.ndarray):
        self.langs, self.log = langs, log

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> TextModel:
        """counts: of each language, how often it has each bucket."""
        langs = sorted(counts)
        smooth = np.array([counts[lang] for lang in langs], np.float64).reshape(len(langs), BUCKETS).T + SMOOTH
        return cls(langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        counts: dict[str, np.ndarray] = {}
        for lang, text in rows:
            counts[lang] = counts.get(lang, 0) + triple_counts(text)
        return cls.of_counts(counts)

    def score(self, text: str) -> np.ndarray:
        """Log likelihood of each language, tempered; zeros for a text without triples."""
        out = np.zeros(len(self.langs))
        for codes in triples(text):
            out += self.log[codes].sum(axis=0, dtype=np.float64)
        return TEMPER * out


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of (lang, ..., counts), counts as the buckets that occur and how often."""
    *first, counts = zip(*rows)
    at = [np.flatnonzero(c) for c in counts]
    lists = [pa.array([i.astype(np.int32) for i in at], pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(counts, at)], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*map(pa.array, first), *lists], names=[*names, "buckets", "times"])


def _count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 32):
        if batch.num_rows:
            yield _packed([(lang.as_py(), draw.as_py(), triple_counts(text.as_py())) for lang, draw, text in zip(*batch.columns)], ["lang", "draw"])


def _sum_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, buckets, times in zip(*batch.columns):
            sums = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            sums[buckets.values.to_numpy()] += times.values.to_numpy()
    if counts:
        yield _packed(list(counts.items()), ["lang"])


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, langs: int = LANGS) -> TextModel:
    """From labelled rows of every language, of the `langs` most frequent ones if there are more: of each its share of `sample`, and at least `LEAST` or all it has.

    Of a language those with the smallest hashes of id and text are drawn, and rows equal in both count as one, however
    often they repeat. A first filter by hash lets a third more through than are drawn, and always the smallest, so no
    task holds more than that. Texts stay where they are: tasks count their triples, which is at most `BUCKETS` numbers a
    drawn row, and add them up in `SUMS` parts, which is at most as many for each language in what the driver gets.
    """
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    frequent = labelled.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"), F.min("draw").alias("first")).orderBy(F.desc("n"), "lang").limit(langs)
    known = frequent.collect()
    if not known:
        return TextModel.fit([])
    whole = sum(r["n"] for r in known)
    quota = {r["lang"]: max(LEAST, sample * r["n"] // whole) for r in known}
    bounds = [(r["lang"], quota[r["lang"]], max(r["first"] + 1, int((1 << 40) * min(1.0, 1.3 * quota[r["lang"]] / r["n"])))) for r in known]
    most = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most long, below long"))
    asked = labelled.join(most, "lang").filter("draw < below").select("lang", "draw", "text")
    counted = asked.mapInArrow(_count_triples, "lang string, draw long, buckets array<int>, times array<long>")
    once = counted.groupBy("lang", "draw").agg(F.first(F.struct("buckets", "times")).alias("c"))
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).join(most, "lang").filter("k <= most")
    sums = ranked.select("lang", "c.buckets", "c.times").coalesce(SUMS).mapInArrow(_sum_triples, "lang string, buckets array<int>, times array<long>")
    counts: dict[str, np.ndarray] = {}
    for lang, buckets, times in sums.toLocalIterator():
        counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += np.array(times, np.int64)
    return TextModel.of_counts(counts)


def _evidence(model: TextModel, pages: bool, kind: str):
    n = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            said, logs, posts = [], [], []
            with np.errstate(over="ignore"):
                for x in batch.column(1):
                    text = x.as_py() or ""
                    said.append(declared(text) if pages else "")
                    log = model.score(visible(text) if pages else text)
                    p = np.exp(log - log.max()) if n else log
                    logs.append(log.tolist())
                    posts.append((p / p.sum()).tolist() if n else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(said, pa.string()), pa.array(logs, pa.list_(pa.float64())), pa.array(posts, pa.list_(pa.float64()))], names=["id", "host", "declared", "log", "post"])

    return run, f"id {kind}, host string, declared string, log array<double>, post array<double>"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def evidence(rows: DataFrame, model: TextModel, id_col: str, body_col: str, host: Column, pages: bool) -> DataFrame:
    """(id, host, declared, log, post) of each row: what its own text and markup say.

    A null text counts as empty: its log likelihoods are all zero and its post is the same for all languages. A null
    host is empty. Ids may be null or repeat.
    """
    asks = rows.select(F.col(id_col).alias("id"), F.col(body_col).alias("body"), F.coalesce(host, F.lit("")).alias("host"))
    run, schema = _evidence(model, pages, asks.schema["id"].dataType.simpleString())
    return asks.mapInArrow(run, schema)


#: A key with at least one of so many rows is hot; there are at most so many of them.
HOT = 1_000


def _with_sums(rows: DataFrame, key: str, n: int, every: int, name: str) -> DataFrame:
    """rows with the sums of post over all rows of the same key, as an array.

    The sums of hot keys, at most HOT rows, go to every task. Rows with a hot key are then dealt out by their ids, the
    others by their keys.
    """
    sums = rows.groupBy(key).agg(F.array(*(F.sum(F.col("post")[i]) for i in range(n))).alias("_sum"), F.count("*").alias("_n"))
    hot = F.broadcast(sums.filter(F.col("_n") * HOT >= every).select(key, F.col("_sum").alias("_hot")))
    cold = sums.filter(F.col("_n") * HOT < every).select(F.col(key).alias("_key"), F.col("_sum").alias("_cold"))
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(HOT)).cast("string"))
    met = rows.join(hot, key, "left").withColumn("_own", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    return met.join(cold, F.col("_own") == F.col("_key"), "left").withColumn(name, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_own", "_key")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows of evidence() with suffix, text_lang, lang and confidence.

    For each language: the text's log likelihood, the logs of how often its declaration and its suffix go with the
    language, and the log of its host's prior. Ties go to the first language in order. Without any evidence the whole
    table's languages decide; rows without text, markup and host get them, too. text_lang is null without text.
    """
    n = len(langs)
    names = F.array(*map(F.lit, langs))
    each = lambda f: F.array(*(f(i) for i in range(n)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    labels = F.split("host", r"\.")
    base = rows.select(
        "*",
        F.element_at(labels, -1).alias("suffix"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("domain"),
    )
    whole = base.agg(F.count("*"), *(F.sum(F.col("post")[i]).alias(f"w{i}") for i in range(n))).first()
    every, total = whole[0], [float(x or 0.0) + 1.0 for x in whole[1:]]
    top = [x / sum(total) for x in total]
    # what markup declares has at most three letters, so its sums are at most 18,253 rows
    says = base.groupBy("declared").agg(F.array(*(F.sum(F.col("post")[i]) for i in range(n))).alias("declared_sum"))
    met = base.join(F.broadcast(says), "declared")
    for key in ("suffix", "domain", "host"):
        met = _with_sums(met, key, n, every, f"{key}_sum")
    # others of the domain, then others of the host
    rest = lambda c: each(lambda i: F.greatest(F.col(c)[i] - F.col("post")[i], F.lit(0.0)))
    lean = lambda own, up: each(lambda i: (own[i] + LEAN * up[i]) / (add(own) + LEAN))
    prior0 = met.withColumn("prior", F.when(F.col("host") == "", F.array(*map(F.lit, top))).otherwise(lean(rest("domain_sum"), F.array(*map(F.lit, top)))))
    prior = prior0.withColumn("prior", F.when(F.col("host") == "", F.col("prior")).otherwise(lean(rest("host_sum"), F.col("prior"))))
    goes = lambda c: each(lambda i: F.log((F.greatest(F.col(c)[i] - F.col("post")[i], F.lit(0.0)) + 0.5) / F.lit(total[i] + 1.0)))
    quiet = F.array(*[F.lit(0.0)] * n)
    fused = prior.withColumn("said", F.when(F.col("declared") == "", quiet).otherwise(goes("declared_sum"))).withColumn("ended", F.when(F.col("suffix") == "", quiet).otherwise(goes("suffix_sum")))
    score = fused.withColumn("score", each(lambda i: F.col("log")[i] + F.col("said")[i] + F.col("ended")[i] + F.log(F.col("prior")[i])))
    best = F.array_max("score")
    return score.select(
        "id", "host", "declared", "suffix",
        F.when(F.exists("log", lambda x: x != 0), F.get(names, F.array_position("post", F.array_max("post")).cast("int") - 1)).alias("text_lang"),
        F.get(names, F.array_position("score", best).cast("int") - 1).alias("lang"),
        (1.0 / add(F.transform("score", lambda s: F.exp(s - best)))).alias("confidence"),
    )


#: From this probability on, a row counts as being in its language.
SURE = 0.5


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, host, declared, suffix, text_lang, lang, confidence, kept): a row for each document and each page.

    Documents have no markup and no address; their source takes the host's place, and doc_id is theirs. Pages have all
    kinds of evidence and page_id. A null text or page counts as empty, a null url or source has no host. Ids may be
    null or repeat; other columns don't matter. Without a labelled document there are no languages: lang is null and
    nothing is kept.
    """
    model = fit_text_model(docs)
    if not model.langs:
        lost = [F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("declared", "string"), ("suffix", "string"), ("text_lang", "string"), ("lang", "string"), ("confidence", "double"))]
        ids = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id")).unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long")))
        return ids.select("*", *lost, F.lit(False).alias("kept"))
    mine = evidence(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, "doc_id", "text", F.col("source"), False).withColumn("page", F.lit(False))
    theirs = evidence(pages.withColumn("page_id", F.col("page_id").cast("long")), model, "page_id", "html", host_of(F.col("url")), True).withColumn("page", F.lit(True))
    rows = table(mine.unionByName(theirs).withColumn("id", F.struct("page", "id")).drop("page"), "evidence")
    found = fuse(rows, model.langs)
    return found.select(
        F.when(~F.col("id.page"), F.col("id.id")).alias("doc_id"),
        F.when(F.col("id.page"), F.col("id.id")).alias("page_id"),
        "host", "declared", "suffix", "text_lang", "lang", "confidence",
        (F.col("confidence") >= SURE).alias("kept"),
    )
