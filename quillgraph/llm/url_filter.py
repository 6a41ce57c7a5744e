"""URL rules in a sorted digest array.

A rule is a host and a path prefix. The index is one file: the sorted 64-bit xxhash keys of the rules' host+path
strings, then the strings themselves. Executors memory-map it, so all workers of a machine share its pages. A url asks
for each of its host's suffixes with each path prefix that is as long as a rule's; all questions of a batch are
answered by one vectorised binary search, and a hit counts only if the stored string equals the one asked for.

The driver writes the file to the cluster's shared folder and Spark hands it to every executor, also to one that
replaces a lost one. Its size is that of the rules, not of the data, and is checked against `MAX_BYTES`; more rules
than that are a table, and `judge_urls_by_join` has the same result by joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, scratch_root, small, table

#: The largest index that is handed to every executor.
MAX_BYTES = 1 << 30


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


VERDICTS = ("allow", "block")


def build(rules: Iterable[Rule]) -> bytes:
    """The index: three counts, digests, string ends, verdicts, path lengths, depths of hosts, strings.

    Of equal rules the last one holds. Rules keep only a-z of A-Z in their host.
    """
    by = {}
    for r in rules:
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.host)
        by[f"{host}\0{r.path}"] = VERDICTS.index(r.verdict)
    keys = [k.encode() for k in by]
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    order = np.argsort(digests, kind="stable")
    keys = [keys[i] for i in order]
    ends = np.cumsum([0, *map(len, keys)]).astype(np.int64)
    verdicts = np.array(list(by.values()), np.int64)[order]
    lengths = np.array(sorted({len(k.split(b"\0", 1)[1]) for k in keys}), np.int64)
    depth = max((k.split(b"\0", 1)[0].count(b".") + 1 for k in keys), default=0)
    out = b"".join([np.array([len(keys), len(lengths), depth], np.int64).tobytes(), digests[order].tobytes(), ends.tobytes(), verdicts.tobytes(), lengths.tobytes(), *keys])
    if len(out) > MAX_BYTES:
        raise ValueError(f"the rules need {len(out)} bytes; {MAX_BYTES} are the most")
    return out


class Index:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m, self.depth = (int(x) for x in raw[:24].view(np.int64))
        at = 24
        self.digests = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.verdicts = raw[at : at + 8 * n].view(np.int64)
        at += 8 * n
        self.lengths = raw[at : at + 8 * m].view(np.int64).tolist()
        self.strings = raw[at + 8 * m :]

    def questions(self, host: str, path: str) -> Iterator[bytes]:
        """Longest first; of equally long ones, the longer host first."""
        parts = host.split(".")
        hosts = [".".join(parts[-k:]).encode() for k in range(min(self.depth, len(parts)), 0, -1)]
        full = path.encode()
        own = [(h, full[:k]) for h in hosts for k in self.lengths if k <= len(full)]
        own.sort(key=lambda x: -len(x[0]) - len(x[1]))
        return (h + b"\0" + p for h, p in own)

    def find(self, asked: list[bytes]) -> np.ndarray:
        """The rule of each string, or -1."""
        out = np.full(len(asked), -1, np.int64)
        if not asked or not len(self.digests):
            return out
        want = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        at = np.searchsorted(self.digests, want)
        near = np.minimum(at, len(self.digests) - 1)
        for i in np.flatnonzero(self.digests[near] == want):
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == want[i]:
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == asked[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def rule(self, k: int) -> tuple[str, str]:
        host, path = self.strings[self.ends[k] : self.ends[k + 1]].tobytes().decode().split("\0", 1)
        return host + path, VERDICTS[self.verdicts[k]]


def publish(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Write the index to the shared folder and hand it to the executors; returns its file name there."""
    data = build(rules)
    name = f"urls-{uuid.uuid4().hex[:12]}.idx"
    where = f"{scratch_root(spark)}/{name}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()
    fs.deleteOnExit(path)
    sc.addFile(where)
    return name


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def judge_urls(df: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict): one row for each row of df.

    Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both are empty
    for a null url and one without ://. A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest wins, and of equally long ones that with the longer host. A url that no rule fits gets
    `default` and a null rule. Ids may be null or repeat; other columns of df don't matter.
    """
    name = publish(df.sparkSession, rules)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in small(batches):
            asked, owner = [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if host or path:
                    own = list(index.questions(host, path))
                    asked += own
                    owner += [i] * len(own)
            found = index.find(asked)
            best: dict[int, int] = {}
            for k in np.flatnonzero(found >= 0):  # in the order of the questions: the first is the longest
                best.setdefault(owner[k], int(found[k]))
            rules_ = [index.rule(best[i]) if i in best else (None, default) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in rules_], pa.string()), pa.array([v for _, v in rules_], pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    asks = df.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    return asks.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, host string, path string, rule string, verdict string")


def judge_urls_by_join(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same as judge_urls() for any number of rules(host, path, verdict), which are a table; of equal rules the last verdict by name holds.

    A url asks by each suffix of its host, and of its path by the lengths that rules of that host have: two joins on
    keys, in place of the index, which has a largest size.
    """
    own = rules.select(lower_ascii(F.col("host")).alias("_host"), F.col("path").alias("_path"), "verdict").groupBy("_host", "_path").agg(F.max("verdict").alias("_verdict"))
    lengths = own.groupBy("_host").agg(F.collect_set(F.char_length("_path")).alias("_lengths"))
    url = F.col(url_col)
    rows = table(df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")), "urls")
    labels = F.split("host", r"\.")
    asks = rows.filter("host <> '' or path <> ''").select("_row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("_host"))
    cut = asks.join(lengths, "_host").select("_row", "_host", "path", F.explode("_lengths").alias("_n")).filter(F.col("_n") <= F.char_length("path"))
    hits = cut.select("_row", "_host", F.substring(F.col("path"), F.lit(1), F.col("_n")).alias("_path")).join(own, ["_host", "_path"])
    best = hits.groupBy("_row").agg(F.max(F.struct((F.char_length("_host") + F.char_length("_path")).alias("size"), F.char_length("_host").alias("host_size"), F.concat("_host", "_path").alias("rule"), "_verdict")).alias("b"))
    return rows.join(best, "_row", "left").select(F.col("_id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b._verdict", F.lit(default)).alias("verdict"))
