"""Queries over histories kept as intervals; most have the SQL of the ones over states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from . import model
from .more import _versions
from .registry import ORACLES, query
from .tables import D, _files, _snapshots


@query("link_spans", f"""WITH {D}, q AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rk FROM (SELECT DISTINCT seq FROM days_)), st AS (SELECT page, target, 1 AS copies, seq FROM days_ UNION SELECT page, NULL, 0, seq FROM days_),
    f AS (SELECT st.*, rk, CASE WHEN lag(rk) OVER (PARTITION BY page, target ORDER BY rk) = rk - 1 THEN 0 ELSE 1 END AS fresh FROM st JOIN q USING (seq)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page, target ORDER BY rk) AS run FROM f),
    r AS (SELECT page, target, copies, min(seq) AS since, max(rk) AS last FROM g GROUP BY page, target, copies, run)
    SELECT page, target, CAST(copies AS BIGINT) AS copies, CAST(since AS BIGINT) AS since, CAST(seq AS BIGINT) AS until FROM r LEFT JOIN q ON q.rk = last + 1""")
def link_spans(s, d):
    found = intervals.link_spans(_snapshots(s, d), model.days(s, d))
    return found.select("page", "target", "copies", F.col("since").cast("long"), F.col("until").cast("long"))


@query("vault_history_of_spans", ORACLES["vault_history"])
def vault_history_of_spans(s, d):
    return intervals.vault_history(_snapshots(s, d), intervals.link_spans(_snapshots(s, d), model.days(s, d)))


@query("page_history_of_spans", ORACLES["page_history"])
def page_history_of_spans(s, d):
    found = intervals.page_history(intervals.link_spans(_snapshots(s, d), model.days(s, d)))
    return found.select("page", "seq", "event", F.size("added").alias("added"), F.size("removed").alias("removed"))


@query("recent_changes_of_spans", ORACLES["recent_changes"])
def recent_changes_of_spans(s, d):
    return intervals.recent_changes(_snapshots(s, d), intervals.spans(_snapshots(s, d), _files(s, d), ["page", "root_hash"]))


@query("tree_of_spans", ORACLES["tree_at_change"])
def tree_of_spans(s, d):
    return intervals.at(intervals.version_spans(_versions(s, d)), 12).select("path", "content")


@query("kept_history", f"""WITH {D}, n AS (SELECT max(seq) AS last FROM days_), p AS (SELECT 'then' AS asked, page, target FROM days_, n WHERE seq = last - 4 UNION ALL SELECT 'now', page, target FROM days_, n WHERE seq = last),
    o AS (SELECT page, target FROM days_, n WHERE seq = last - 1), c AS (SELECT page, target FROM days_, n WHERE seq = last)
    SELECT * FROM p UNION ALL SELECT 'came', page, target FROM (SELECT * FROM c EXCEPT SELECT * FROM o) UNION ALL SELECT 'went', page, target FROM (SELECT * FROM o EXCEPT SELECT * FROM c)""")
def kept_history(s, d):
    """All snapshots but three are loaded, those are appended; then the state four before the newest, the newest, and the last step."""
    days, snaps = model.days(s, d), _snapshots(s, d)
    last = snaps.agg(F.max("seq")).first()[0] or 0
    h = intervals.kept(s, "page string, target string, copies long")
    h.load(intervals.link_spans(snaps.filter(F.col("seq") <= last - 3), days.filter(F.col("seq") <= last - 3)), last - 3)
    for k in range(last - 2, last + 1):
        h.append(k, intervals.link_states(days.filter(F.col("seq") == k)))
    links = lambda df, asked: df.filter("target is not null").select(asked.alias("asked"), "page", "target")
    moved = links(h.between(last - 1, last), F.when(F.col("came"), "came").otherwise("went"))
    return links(h.at(last - 4), F.lit("then")).unionByName(links(h.at(last), F.lit("now"))).unionByName(moved)
