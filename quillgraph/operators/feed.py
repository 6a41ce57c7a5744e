"""Feeds: which pages are items, how long they stay, what may be republished, and what has been seen before."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.names import glob

#: Licences told apart, and the usual number of items.
LICENSES = ("CC0-1.0", "CC-BY-4.0", "CC-BY-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")
UNKNOWN = "NOASSERTION"
MOST_ITEMS = 50


def license_of(spdx: Column) -> Column:
    """A known licence, any other name as it is, or NOASSERTION."""
    return F.when(F.trim(F.coalesce(spdx, F.lit(""))).isin("", UNKNOWN), UNKNOWN).otherwise(F.trim(spdx))


def license_from_url(url: Column) -> Column:
    """The licence that an address of Creative Commons names; null for others."""
    c = F.lower(F.regexp_replace(F.trim(url), r"^https?://(?:www\.)?", ""))
    kind, version = (F.regexp_extract(c, r"^creativecommons\.org/licenses/([a-z-]+)/(\d\.\d)", i) for i in (1, 2))
    return F.when(c.startswith("creativecommons.org/publicdomain/zero/1.0"), "CC0-1.0").when(kind != "", F.concat(F.lit("CC-"), F.upper(kind), F.lit("-"), version))


def resolve_license(override: Column, link: Column, rights: list[Column]) -> Column:
    """The first that says something: an override, a licence link, then texts of rights."""
    said = lambda c: F.nullif(license_of(c), F.lit(UNKNOWN))
    text = [F.coalesce(license_from_url(F.regexp_extract(r, r"(https?://\S+)", 1)), F.nullif(F.regexp_extract(r, r"\b(CC0-1\.0|CC-BY(?:-(?:SA|NC|ND))?-[34]\.0)\b", 1), F.lit(""))) for r in rights]
    return F.coalesce(said(override), license_from_url(link), *text, F.lit(UNKNOWN))


def republication(license_: Column, republish: Column, mode: Column, own_license: Column, commercial: Column, permitted: Column) -> tuple[Column, Column]:
    """(mode, reason) by a table of licence and policy; mode is full, excerpt or deny."""
    full = mode == "full"
    cases = [
        (~republish, "deny", "unknown_default_deny"),
        (license_ == "CC0-1.0", "full", "public_domain"),
        (license_.isin("CC-BY-4.0", "CC-BY-3.0") & full, "full", "cc_by_full"),
        (license_.isin("CC-BY-4.0", "CC-BY-3.0"), "excerpt", "cc_by_excerpt"),
        ((license_ == "CC-BY-SA-4.0") & F.coalesce(own_license == "CC-BY-SA-4.0", F.lit(False)) & full, "full", "cc_by_sa_compatible"),
        (license_ == "CC-BY-SA-4.0", "excerpt", "cc_by_sa_incompatible"),
        ((license_ == "CC-BY-NC-4.0") & ~commercial & full, "full", "cc_by_nc_non_commercial"),
        (license_ == "CC-BY-NC-4.0", "excerpt", "cc_by_nc_commercial"),
        (license_ == "CC-BY-ND-4.0", "excerpt", "cc_by_nd_excerpt_only"),
        (permitted & full, "full", "unknown_operator_permitted"),
        (permitted, "excerpt", "unknown_operator_permitted"),
    ]
    out = [F.lit("deny"), F.lit("unknown_default_deny")]
    for test, *values in reversed(cases):
        out = [F.when(test, v).otherwise(o) for v, o in zip(values, out, strict=True)]
    return out[0], out[1]


def matches_rule(kind: str, value: str | None = None) -> Column:
    """Items of a page with opt_in, path and tags: those that opted in, in a folder, or with a tag."""
    if kind == "opt_in":
        return F.coalesce(F.col("opt_in"), F.lit(False))
    if kind == "folder":
        return F.col("path").startswith(value.rstrip("/") + "/")
    if kind == "tag":
        return F.coalesce(F.array_contains("tags", value), F.lit(False))
    raise ValueError(f"not a rule: {kind}")


def select_items(pages: DataFrame, rule: Column, most: int = MOST_ITEMS) -> DataFrame:
    """The newest items that a rule picks: by date, newest first, then id."""
    return pages.filter(rule).orderBy(F.desc("date_published"), "id").limit(most)


def in_set(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pages that a rule set concluded: chosen(slug)."""
    return pages.join(chosen.select("slug").distinct(), "slug", "left_semi")


def scoped(pages: DataFrame, scopes: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(scope, rank, id) for scopes(scope, prefix): each scope's newest visible pages.

    Prefixes are joined as in below().
    """
    both = below(pages, scopes)
    order = Window.partitionBy("scope").orderBy(F.desc("date_published"), "id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("scope", "rank", "id")


def below(pages: DataFrame, scopes: DataFrame) -> DataFrame:
    """pages(path, ...) with each of scopes(scope, prefix, ...) whose prefix their path begins with.

    Prefixes with a folder are joined on their first one; only those without are tried with every page.
    """
    first = lambda c: F.substring_index(c, "/", 1)
    named = scopes.filter(F.col("prefix").contains("/")).withColumn("_first", first(F.col("prefix")))
    near = pages.withColumn("_first", first(F.col("path"))).join(named, "_first").filter(F.col("path").startswith(F.col("prefix"))).drop("_first")
    return near.unionByName(pages.join(scopes.filter(~F.col("prefix").contains("/")), F.col("path").startswith(F.col("prefix"))))


def retention_plan(items: DataFrame, policy: str, now: str) -> DataFrame:
    """items(subscription, id, date_published, pinned) with `action`: keep, archive or delete.

    Pinned items are kept. Ages compare texts of times; a count keeps the newest of each subscription.
    """
    kind, n = dates.retention(policy)
    if kind == "forever":
        return items.withColumn("action", F.lit("keep"))
    if kind == "seconds":
        cutoff = dates.minus_seconds(F.lit(now), n)
        keep = F.col("date_published") >= cutoff
    else:
        order = Window.partitionBy("subscription").orderBy(F.desc("date_published"), "id")
        items = items.withColumn("_k", F.row_number().over(order))
        keep = F.col("_k") <= n
    action = F.when(keep | F.coalesce(F.col("pinned"), F.lit(False)), "keep").when(F.coalesce(F.col("archivable"), F.lit(False)) if "archivable" in items.columns else F.lit(False), "archive").otherwise("delete")
    return items.withColumn("action", action).drop("_k")


def seen_before(items: DataFrame, known: DataFrame) -> DataFrame:
    """items(guid, link, hash, ...) with `seen`: any of the three, if it isn't empty, is that of a known item.

    Three equi-joins, not one on any of three conditions.
    """
    out, flags = items, []
    for c in ("guid", "link", "hash"):
        keys = known.select(F.col(c).alias(f"_{c}")).filter(F.col(f"_{c}") != "").distinct().withColumn(f"_has_{c}", F.lit(True))
        out = out.join(keys, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
        flags.append(F.coalesce(F.col(f"_has_{c}"), F.lit(False)))
    return out.withColumn("seen", flags[0] | flags[1] | flags[2]).drop("_has_guid", "_has_link", "_has_hash")


def forget_plan(items: DataFrame, pattern: str | None = None, guid_prefix: str | None = None, hash_prefix: str | None = None) -> DataFrame:
    """(id, action) of items(id, path, guid, hash, archived) that a request names: removed, or erased from the archive."""
    hit = F.lit(False)
    for c, test in (("path", pattern and glob(F.col("path"), pattern)), ("guid", guid_prefix and F.col("guid").startswith(guid_prefix)), ("hash", hash_prefix and F.col("hash").startswith(hash_prefix))):
        if test is not None and test is not False and not isinstance(test, str):
            hit = hit | F.coalesce(test, F.lit(False))
    return items.filter(hit).select("id", F.when(F.col("archived"), "erase").otherwise("remove").alias("action"))


def rewrite_links(pages: DataFrame, slugs: DataFrame, base: str, unresolved: str = "text") -> DataFrame:
    """(path, html): each wiki link as an anchor to its page, or, unresolved, as its text or as a marked span.

    Links are looked up by a join on their target; a page's parts are put together again in order.
    """
    pattern = r"\[\[([^\[\]]+)\]\]"
    parts = pages.select("path", F.split("content", pattern).alias("between"), F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("found"))
    each = parts.select("path", F.posexplode_outer("found").alias("i", "raw"))
    target = F.trim(F.regexp_extract("raw", r"^([^|#^]*)", 1))
    asked = each.select("path", "i", "raw", F.lower(target).alias("k"), F.coalesce(F.nullif(F.trim(F.regexp_extract("raw", r"\|(.*)$", 1)), F.lit("")), F.col("raw")).alias("label"))
    keys = slugs.groupBy(F.lower("page").alias("k")).agg(F.min("slug").alias("slug"))
    known = asked.join(keys, "k", "left")
    esc = F.replace(F.replace(F.col("label"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    other = F.concat(F.lit('<span class="unresolved">'), esc, F.lit("</span>")) if unresolved == "span" else esc
    made = known.withColumn("a", F.when(F.col("slug").isNotNull(), F.concat(F.lit(f'<a href="{base}'), F.col("slug"), F.lit('">'), esc, F.lit("</a>"))).otherwise(other))
    lists = made.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "a"))).alias("as"))
    joined = parts.select("path", "between").join(lists, "path")
    text = F.array_join(F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get(F.col("as"), i)["a"], F.lit("")))), "")
    return joined.select("path", text.alias("html"))


def _xml(items: DataFrame, one, head: str, tail: str, most: int) -> str:
    """A document from at most `most` items, which the driver writes."""
    return head + "".join(one(r) for r in items.limit(most).collect()) + tail


def rss(items: DataFrame, title: str, link: str, most: int = MOST_ITEMS) -> str:
    items = items.withColumn("_date", dates.rfc822(F.to_timestamp("date_published")))
    one = lambda r: f"<item><title>{escape(r['title'] or '')}</title><link>{escape(r['url'] or '')}</link><guid isPermaLink=\"false\">{escape(r['id'])}</guid><pubDate>{r['_date']}</pubDate><description>{escape(r['summary'] or '')}</description></item>"
    return _xml(items, one, f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link>', "</channel></rss>", most)


def atom(items: DataFrame, title: str, link: str, most: int = MOST_ITEMS) -> str:
    one = lambda r: f"<entry><id>{escape(r['id'])}</id><title>{escape(r['title'] or '')}</title><link href=\"{escape(r['url'] or '')}\"/><updated>{r['date_published']}</updated><summary>{escape(r['summary'] or '')}</summary></entry>"
    return _xml(items, one, f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{escape(title)}</title><id>{escape(link)}</id>', "</feed>", most)


def json_feed(items: DataFrame, title: str, link: str, most: int = MOST_ITEMS) -> str:
    import json

    rows = [json.loads(r[0]) for r in items.limit(most).select(F.to_json(F.struct("id", "url", "title", F.col("summary"), F.col("date_published"), "tags"))).collect()]
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": title, "home_page_url": link, "items": rows}, ensure_ascii=False)


def license_url(license_: Column) -> Column:
    """The address of a known licence, else null."""
    kind = F.lower(F.regexp_extract(license_, r"^CC-([A-Z-]+)-\d", 1))
    known = F.when(license_ == "CC0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/")
    return known.when(license_.isin(*LICENSES), F.concat_ws("/", F.lit("https://creativecommons.org/licenses"), kind, F.right(license_, F.lit(3)), F.lit("")))


def inbound(items: DataFrame, subscriptions: DataFrame, own_license: str | None, commercial: bool, words: int = 120) -> DataFrame:
    """(id, license, license_url, drifted, mode, reason, body) of items(id, subscription, link, rights array, content).

    subscriptions(subscription, license, republish, mode, permitted) say what may be done with a feed's items; an item
    of none is denied. The body is what may be shown: all, the first sentences, or null. `drifted` tells that a licence
    set by hand isn't what the item itself states.
    """
    from ..sources.markdown import excerpt

    def shown(batches):
        for b in batches:
            b["body"] = [t if m == "full" else excerpt(t or "", words) if m == "excerpt" else None for m, t in zip(b["mode"], b["content"], strict=True)]
            yield b.drop(columns=["content"])

    both = items.join(subscriptions, "subscription", "left")
    stated = resolve_license(F.lit(None).cast("string"), F.col("link"), [F.array_join("rights", " ")])
    lic = resolve_license(F.col("license"), F.col("link"), [F.array_join("rights", " ")])
    hand = license_of(F.col("license"))
    mode, reason = republication(lic, F.coalesce("republish", F.lit(False)), F.coalesce("mode", F.lit("excerpt")), F.lit(own_license).cast("string"), F.lit(commercial), F.coalesce("permitted", F.lit(False)))
    drifted = (hand != UNKNOWN) & (stated != UNKNOWN) & (stated != hand)
    told = both.select("id", lic.alias("license"), license_url(lic).alias("license_url"), drifted.alias("drifted"), mode.alias("mode"), reason.alias("reason"), F.col("content").cast("string").alias("content"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInPandas(shown, f"id {kind}, license string, license_url string, drifted boolean, mode string, reason string, body string")


def retracted(kept: DataFrame, now: DataFrame, at: str) -> DataFrame:
    """kept(subscription, id, ...) with `retracted_at`: `at` for items that their feed, fetched as now(subscription, id), no longer has.

    A feed that wasn't fetched retracts nothing.
    """
    fetched = now.select("subscription").distinct().withColumn("_f", F.lit(True))
    here = now.select("subscription", "id").distinct().withColumn("_h", F.lit(True))
    told = kept.join(fetched, "subscription", "left").join(here, ["subscription", "id"], "left")
    return told.withColumn("retracted_at", F.when(F.col("_f") & F.col("_h").isNull(), F.lit(at))).drop("_f", "_h")


#: A part of a path below which pages are for holders of a link only.
GUARDED = "caps"


def cohort_feeds(pages: DataFrame, members: DataFrame, cohorts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(cohort, rank, id): the newest pages(slug, id, date_published) of each cohort(cohort, enabled) that its grant, members(cohort, slug), allows.

    Pages below a guarded folder are in no feed, nor are cohorts that aren't enabled.
    """
    open_ = pages.filter(~F.col("slug").rlike(rf"(?:^|/){GUARDED}(?:/|$)"))
    both = open_.join(members.join(cohorts.filter("enabled").select("cohort"), "cohort", "left_semi"), "slug")
    order = Window.partitionBy("cohort").orderBy(F.desc("date_published"), "id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("cohort", "rank", "id")
