"""Queries over trees of hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hash_tree, history
from .more import _AT, _VERSIONS, _place, _versions
from .registry import ORACLES, query


def _roots(s, d, change):
    return history.tree_at(_versions(s, d), change).select("path", F.sha2("content", 256).alias("root_hash"))


@query("changed_files_by_tree", ORACLES["changed_files"])
def changed_files_by_tree(s, d):
    old, new = (_roots(s, d, c) for c in ("d9", "d12"))
    depth = hash_tree.depth_for(old.count())
    kept = [hash_tree.stored(hash_tree.tree(r, depth), _place(s, "tree")) for r in (old, new)]
    return hash_tree.compare(*kept, depth)


@query("rebuilt_tree", f"""WITH {_VERSIONS}, f AS (SELECT sha256(path) AS node, sha256(path || chr(10) || sha256(content)) AS hash FROM ({_AT.format(12)}) WHERE content IS NOT NULL),
    one AS (SELECT left(node, 1) AS node, sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)) AS hash, count(*) AS files FROM f GROUP BY 1)
    SELECT 1 AS level, node, hash, files FROM one UNION ALL SELECT 0, '', sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)), CAST(sum(files) AS BIGINT) FROM one HAVING count(*) > 0""")
def rebuilt_tree(s, d):
    """The tree of one day, rebuilt with the changes of the days until another."""
    old, new = hash_tree.stored(hash_tree.tree(_roots(s, d, "d9"), 1), _place(s, "tree")), _roots(s, d, "d12")
    changes = history.changed_names(_versions(s, d), "d9", "d12").select("path").join(new, "path", "left")
    return hash_tree.rebuilt(old, changes, 1).filter("level <= 1").select("level", "node", "hash", "files")
