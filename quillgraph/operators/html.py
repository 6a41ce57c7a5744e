"""Links and raw markup in HTML, compared with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemes that are always reported, schemes with a host, and marks of templates.
DANGEROUS = ("javascript", "data", "vbscript", "file", "about")
EXTERNAL = ("http", "https")
DYNAMIC = r"\{\{|\}\}|\$\{|<%|%>"


def host_of(url: Column) -> Column:
    """Lower-cased, without user, port and a leading `www.`; null without one."""
    raw = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(raw, r"^www\.", ""), F.lit(""))


def urls(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url) of the values of href and src."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)\b(?:href|src)\s*=\s*\"([^\"]*)\""), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.explode(found).alias("url"))


def domains(found: DataFrame) -> DataFrame:
    return found.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()


def audit(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, url, kind) of urls that need a look: dynamic, dangerous, or of a host that baseline(host) hasn't; the first that holds."""
    scheme = F.lower(F.regexp_extract("url", r"^([^:]*):", 1))
    hosts = baseline.select("host").distinct().withColumn("_seen", F.lit(True))
    joined = found.withColumn("host", host_of(F.col("url"))).join(hosts, "host", "left")
    kind = F.when(F.col("url").rlike(DYNAMIC), "dynamic").when(scheme.isin(*DANGEROUS), "dangerous").when(scheme.isin(*EXTERNAL) & F.col("host").isNotNull() & F.col("_seen").isNull(), "unseen_domain")
    return joined.select("id", "url", kind.alias("kind")).filter("kind is not null")


def raw_tags(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", allowed: tuple[str, ...] = ("a", "p", "b", "i", "em", "strong", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "code", "pre", "blockquote", "img", "table", "tr", "td", "th", "span", "div")) -> DataFrame:
    """(id, tag, n): tags that an allow-list of elements would take away."""
    found = F.regexp_extract_all(F.lower(F.col(html_col)), F.lit(r"<([a-z][a-z0-9-]*)"), F.lit(1))
    each = pages.select(F.col(id_col).alias("id"), F.explode(found).alias("tag"))
    return each.filter(~F.col("tag").isin(*allowed)).groupBy("id", "tag").agg(F.count("*").alias("n"))


def fetch_gates(requests: DataFrame, most_bytes: int = 5_000_000) -> DataFrame:
    """requests(url, body) with one Boolean for each gate that an inbound feed passes: scheme, public target, no entities, size."""
    host = host_of(F.col("url"))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1)") | host.endswith(".local") | host.endswith(".internal")
    return requests.select("*", F.lower("url").rlike("^https?://").alias("safe_scheme"), F.coalesce(~private, F.lit(False)).alias("public_target"), (~F.coalesce(F.col("body"), F.lit("")).rlike("(?i)<!(doctype|entity)")).alias("no_entities"), (F.octet_length(F.coalesce(F.col("body"), F.lit(""))) <= most_bytes).alias("under_size"))
