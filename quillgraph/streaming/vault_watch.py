"""A watched vault whose graph follows its changes: work is that of the pages that change, not of the vault.

State is seven tables in buckets: pages and links by path, references by what they say, names and those who ask for
them by key, pairs by target, and how many links and pages each target has. A change of pages retracts their old links and adds the new
ones; a page that comes or goes touches the keys of its name, and only targets that ask for one of these are resolved
again. What that does to pairs of pages is added to counters, and an event is a counter that leaves or reaches zero.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import page_name
from ..scratch import scratch_root, table
from ..sources.vault import Vault
from .buckets import Buckets, bucket, touched
from .watch import DEBOUNCE

TABLES = {
    "pages": "path string, page string, hash string",
    "links": "path string, source string, raw string, named string, n long",
    "refs": "raw string, named string, source string, path string, n long, target string",
    "keys": "key string, steps int, path string, page string",
    "asks": "key string, steps int, raw string, named string",
    "pairs": "target string, source string, n long",
    "ends": "target string, links long, pages long",
}
#: Buckets of a table by default, and parts of the pairs of one target, so that a page with very many links to it isn't one bucket.
BUCKETS, PARTS = 64, 4


def _forms(c: Column) -> list[Column]:
    return [F.lower(c), F.translate(F.lower(c), "-_", "  ")]


def _by_key(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows by each distinct key that isn't null: `key` and `steps`, the sum of 1 << k over the places k of keys that have it."""
    own = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    keys = [F.col(f"_k{i}") for i in range(len(keys))]
    steps = [reduce(add, (F.when(a.eqNullSafe(b), 1 << k).otherwise(0) for k, b in enumerate(keys))) for a in keys]
    each = [F.when(reduce(and_, (~a.eqNullSafe(b) for b in keys[:k]), a.isNotNull()), F.struct(a.alias("key"), steps[k].alias("steps"))) for k, a in enumerate(keys)]
    return own.select(*rows.columns, F.inline(F.array(*each))).filter("key is not null")


def _names(pages: DataFrame) -> DataFrame:
    """(path, page, key, steps): the keys under which pages(path, page) can be meant, with the steps in which they are tried."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    return _by_key(pages.select("path", "page"), [*_forms(F.col("page")), *_forms(stem)])


def _asks(raws: DataFrame) -> DataFrame:
    """(raw, named, key, steps) of raws(raw, named): the keys that a target asks for; only one with a slash asks for paths."""
    slash = F.col("raw").contains("/")
    return _by_key(raws.select("raw", "named"), [*_forms(F.col("named")), *(F.when(slash, c) for c in _forms(F.col("named")))])


def _resolved(asks: DataFrame, names: DataFrame) -> DataFrame:
    """(raw, resolved) of what means something: the first step with a page decides, and there must be one page only."""
    on = [F.col("steps").bitwiseAND(1 << k) != 0 for k in range(4)]
    asked = names.join(asks.select("key"), "key", "left_semi")
    pages = asked.groupBy("key").agg(*(F.count(F.when(x, 1)).alias(f"n{k}") for k, x in enumerate(on)), *(F.min(F.when(x, F.col("page"))).alias(f"p{k}") for k, x in enumerate(on)))
    hit = [F.when(x & (F.col(f"n{k}") > 0), F.struct(F.lit(k).alias("step"), F.col(f"n{k}").alias("n"), F.col(f"p{k}").alias("page"))) for k, x in enumerate(on)]
    first = asks.join(pages, "key").groupBy("raw").agg(F.min(F.coalesce(*hit)).alias("f"))
    return first.filter("f.n = 1").select("raw", F.col("f.page").alias("resolved"))


def _summed(old: DataFrame | None, change: DataFrame, by: list[str], *counts: str) -> DataFrame:
    """Counters by key before and after a change: (by, was_x, now_x for each count x). A change has a key once; None are none before."""
    if old is None:
        return change.select(*by, *(F.lit(0).cast("long").alias(f"was_{x}") for x in counts), *(F.col(x).alias(f"now_{x}") for x in counts))
    both = old.select(*by, F.lit(True).alias("_old"), *counts).unionByName(change.select(*by, F.lit(False).alias("_old"), *counts))
    return both.groupBy(*by).agg(*(F.sum(F.when(F.col("_old"), F.col(x)).otherwise(0)).alias(f"was_{x}") for x in counts), *(F.sum(x).alias(f"now_{x}") for x in counts))


class VaultWatch:
    """Pages that arrive as a stream of (path, seq, content), of which the newest of a path counts and null content removes.

    Each trigger hands its events (event, page, target) and then one `index_updated` to the sink, if any page's text
    changed. Events are those of graph.graph_diff: pages, links between pages, orphans and dead links that come or go.
    What a link says has one meaning in all pages, as names have no scopes. An epoch that is run again gives the same
    events; a restarted driver goes on from the newest whole epoch.

    buckets is fixed with the first epoch: a change rewrites the buckets of what it touches, so there should be about as
    many as a change has pages, or more. A key that very many pages share, as `readme`, is one bucket.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame, int], None], state: str | None = None, buckets: int = BUCKETS, vault: Callable[[DataFrame], Vault] = Vault):
        self.spark, self.sink, self.vault, self.n = spark, sink, vault, buckets
        self.state = state or f"{scratch_root(spark)}/vault-watch-{uuid.uuid4().hex[:12]}"
        self.tables = Buckets(spark, self.state, TABLES, buckets)

    @property
    def pages(self) -> DataFrame:
        """(path, page, hash)"""
        return self.tables.latest().read("pages")

    @property
    def edges(self) -> DataFrame:
        """(source, target), each pair once."""
        return self.tables.latest().read("pairs").select("source", "target")

    def _pair_bucket(self) -> Column:
        return F.pmod(bucket(self.n, "target") + bucket(PARTS, "source"), F.lit(self.n)).cast("int")

    def batch(self, df: DataFrame, epoch: int) -> None:
        t, n = self.tables, self.n
        t.begin(epoch)
        # without a state there is nothing to meet, so steps between are not written, nor buckets asked for
        first = not t.now
        met = (lambda rows, _: rows) if first else table
        within = (lambda *_: list(range(n))) if first else touched
        newest = Window.partitionBy("path").orderBy(F.desc("seq"))
        got = table(df.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").select("path", "content"), "arrived")
        hashed = got.withColumn("hash", F.sha2("content", 256))
        known = t.read("pages", within(got, n, "path"))
        changed = hashed.join(known.select("path", "page", F.col("hash").alias("was")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("was")))
        changed = met(changed, "changed")
        if changed.isEmpty():
            return
        by_path = within(changed, n, "path")
        known = t.read("pages", by_path)
        vault = self.vault(changed.filter("content is not null").select("path", "content", "hash"))
        there = vault.source if "hash" in vault.source.columns else vault.source.select("path").join(changed.select("path", "hash"), "path")
        there = there.select("path", page_name(F.col("path")).alias("page"), "hash")
        came = met(there.join(known.select("path"), "path", "left_anti").select("path", "page"), "came")
        went = t.none("pages").select("path", "page") if first else table(changed.filter("content is null").select("path", "page"), "went")
        mine = met(t.read("links", by_path).join(changed.select("path"), "path", "left_semi"), "retracted")
        new = table(vault.references, "added")
        t.write("pages", known.join(changed.select("path"), "path", "left_anti").unionByName(there), bucket(n, "path"), by_path)
        t.write("links", t.read("links", by_path).join(changed.select("path"), "path", "left_anti").unionByName(new), bucket(n, "path"), by_path)

        # names that come or go, and who asks for them
        keys = met(_names(came).withColumn("d", F.lit(1)).unionByName(_names(went).withColumn("d", F.lit(-1))), "keys")
        by_key = within(keys, n, "key")
        names = t.read("keys", by_key)
        rest = names.join(went.select("path"), "path", "left_anti").unionByName(keys.filter("d = 1").drop("d"))
        t.write("keys", rest, bucket(n, "key"), by_key)
        again = t.read("asks", by_key).join(keys.select("key").distinct(), "key", "left_semi").select("raw", "named")
        raws = table(mine.select("raw", "named").unionByName(new.select("raw", "named")).unionByName(again).distinct(), "raws")

        # their meanings, and the references that have them
        asks = _asks(raws)
        by_ask, by_raw = within(asks, n, "key"), within(raws, n, "raw")
        refs = t.read("refs", by_raw)
        old = met(refs.join(raws, ["raw", "named"], "left_semi"), "old-refs")
        still = old.drop("target").join(changed.select("path"), "path", "left_anti").unionByName(new)
        target = F.when((F.col("named") == "") & F.col("raw").startswith("#"), F.col("source")).otherwise(F.coalesce("resolved", "named"))
        now = table(still.join(_resolved(asks, t.read("keys", by_ask)), "raw", "left").withColumn("target", target).drop("resolved"), "new-refs")
        t.write("refs", refs.join(raws, ["raw", "named"], "left_anti").unionByName(now), bucket(n, "raw"), by_raw)
        # nobody asks for what no reference says any more
        said = asks if first else asks.join(now.select("raw").distinct(), "raw", "left_semi")
        t.write("asks", t.read("asks", by_ask).join(raws, ["raw", "named"], "left_anti").unionByName(said), bucket(n, "key"), by_ask)

        # counters of pairs and of the links and pages of targets, and what crosses zero
        moved = now.select("source", "target", "n").unionByName(old.select("source", "target", (-F.col("n")).alias("n")))
        pairs = table(moved.groupBy("target", "source").agg(F.sum("n").alias("n")).filter("n <> 0"), "pairs")
        zero = F.lit(0).cast("long")
        titles = came.select(F.col("page").alias("target"), zero.alias("links"), F.lit(1).alias("pages")).unionByName(went.select(F.col("page").alias("target"), zero.alias("links"), F.lit(-1).alias("pages")))
        ends = table(titles.unionByName(pairs.select("target", F.col("n").alias("links"), zero.alias("pages"))).groupBy("target").agg(F.sum("links").alias("links"), F.sum("pages").alias("pages")), "ends")
        by_end = within(ends, n, "target")
        by_pair = list(range(n)) if first else sorted(r[0] for r in pairs.select(self._pair_bucket()).distinct().collect())
        wide = sorted({*by_pair, *((b + k) % n for b in by_end for k in range(PARTS))})
        own = lambda frame: None if first else frame.join(ends, "target", "left_semi")
        here = t.read("pairs", wide)
        told = met(_summed(own(here), pairs, ["target", "source"], "n"), "pair-counts")
        counts = met(_summed(own(t.read("ends", by_end)), ends, ["target"], "links", "pages"), "end-counts")
        inside = self._pair_bucket().isin(by_pair) if by_pair else F.lit(False)
        after = told.filter("now_n > 0").select("target", "source", F.col("now_n").alias("n"))
        t.write("pairs", here.join(ends, "target", "left_anti").unionByName(after).filter(inside), self._pair_bucket(), by_pair)
        after = counts.filter("now_links > 0 or now_pages > 0").select("target", F.col("now_links").alias("links"), F.col("now_pages").alias("pages"))
        t.write("ends", t.read("ends", by_end).join(ends, "target", "left_anti").unionByName(after), bucket(n, "target"), by_end)
        self.sink(_events(told, counts), epoch)
        t.commit()

    def start(self, stream: DataFrame, debounce_ms: int = DEBOUNCE[2], checkpoint: str | None = None) -> StreamingQuery:
        wait = min(DEBOUNCE[1], max(DEBOUNCE[0], debounce_ms))
        writer = stream.writeStream.foreachBatch(self.batch).trigger(processingTime=f"{wait} milliseconds")
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def _events(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(event, page, target) of counters before and after, and one `index_updated`."""
    c = F.col
    ends = counts.select("target", *((c(f"{w}_{x}") > 0).alias(f"{w}_{x}") for w in ("was", "now") for x in ("links", "pages")))
    both = pairs.select("target", "source", *((c(f"{w}_n") > 0).alias(f"{w}_n") for w in ("was", "now"))).join(ends.select("target", "was_pages", "now_pages"), "target")

    def marks(frame: DataFrame, page: str, target: Column, *kinds: tuple[Column, Column, str, str]) -> DataFrame:
        each = F.array(*(F.when(before & ~now, gone).when(now & ~before, come) for before, now, gone, come in kinds))
        return frame.select(F.explode(each).alias("event"), c(page).alias("page"), target.alias("target")).filter("event is not null")

    own = marks(ends, "target", F.lit(None).cast("string"), (c("was_pages"), c("now_pages"), "page_removed", "page_added"), (c("was_pages") & ~c("was_links"), c("now_pages") & ~c("now_links"), "orphan_resolved", "orphan_gained"))
    linked = marks(both, "source", c("target"), (c("was_n"), c("now_n"), "link_removed", "link_added"), (c("was_n") & ~c("was_pages"), c("now_n") & ~c("now_pages"), "dead_resolved", "dead_gained"))
    return own.unionByName(linked).unionByName(ends.sparkSession.createDataFrame([("index_updated", None, None)], "event string, page string, target string"))
