"""The scan as a data source against the rules on a plain listing of all files."""

import os
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillgraph.sources import scan as source
from quillgraph.sources import vault
from quillgraph.sources.scan import Asked, Rules, listing, scan, scan_stream
from quillgraph.streaming.vault_watch import VaultWatch

FILES = [
    "a.md", "b.txt", "x/c.md", "x/.hid/d.md", ".git/e.md", ".kept/f.spl", ".kept/.deep/g.md", "assets/h.md", "x/assets/i.md", "drafts/j.md", "x/drafts/k.md",
    "node_modules/l.md", "in/node_modules/m.md", "inner/.vault/n.md", "inner/o.md", "nest/p.md", "nest/q/r.md", "old-1/s.md", "t/old-2.md", "u/v/w.fountain", ".x.md", "été/ü.md",
]


def make(root, files=FILES):
    for f in files:
        at = root / f
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"# {f}")


def test_rules_as_on_all_files(spark, tmp_path):
    make(tmp_path)
    every = spark.createDataFrame([(f,) for f in FILES], "path string")
    for options in ({}, {"exclude": ("drafts/", "old-*", "**/old-?.md")}, {"include_hidden": True}, {"whitelist": (".kept",)}, {"whitelist": (".kept/.deep",)}, {"nested": ("nest",), "marker": ".vault"}, {"exclude": ("x/**",), "include_hidden": True}):
        want = {r.path for r in vault.scanned(every, **options).collect()}
        got = scan(spark, str(tmp_path), Rules(**options)).collect()
        assert {r.path for r in got} == want, options
        assert all(r.content == f"# {r.path}" for r in got) and len(got) == len(want)


def test_left_out_folders_are_not_entered(tmp_path):
    make(tmp_path)
    entered = []
    found = [p for p, _, _ in listing(str(tmp_path), Rules(exclude=("drafts/",), nested=("nest",), marker=".vault"), entered=entered)]
    assert not {".git", "assets", "drafts", "node_modules", "in/node_modules", "inner/.vault", "nest", "nest/q", ".kept", "x/.hid"} & set(entered)
    assert sorted(found) == sorted(p for p in found) and "a.md" in found and "x/drafts/k.md" in found


def test_filters_reach_the_listing(spark, tmp_path):
    make(tmp_path)
    old = (datetime.now(timezone.utc) - timedelta(days=9)).timestamp()
    os.utime(tmp_path / "x/c.md", (old, old))
    df = scan(spark, str(tmp_path))
    assert {r.path for r in df.filter(F.col("path").startswith("x/")).collect()} == {"x/c.md", "x/assets/i.md", "x/drafts/k.md"}
    assert [r.path for r in df.filter("path = 'u/v/w.fountain'").collect()] == ["u/v/w.fountain"]
    assert {r.path for r in df.filter(F.col("path").isin("a.md", "x/c.md", "no.md")).collect()} == {"a.md", "x/c.md"}
    assert "x/c.md" not in {r.path for r in df.filter(F.col("mtime") > F.current_timestamp() - F.expr("interval 1 day")).collect()}
    entered = []
    asked = Asked(prefixes=["u/v"])
    assert [p for p, _, _ in listing(str(tmp_path), Rules(), asked, entered)] == ["u/v/w.fountain"] and sorted(entered) == ["", "u", "u/v"]
    assert {r.content for r in scan(spark, str(tmp_path), content=False).collect()} == {None}


def test_parts(monkeypatch):
    monkeypatch.setattr(source, "PART_BYTES", 10)
    got = source.parts(iter([("a", 0, 4), ("b", 0, 7), ("c", 0, 1)]))
    assert [[f for f, _ in p.files] for p in got] == [["a", "b"], ["c"]] and source.parts(iter([])) == []


def test_a_folder_that_changes(spark, tmp_path):
    """The stream gives changes to a watch; a restarted one goes on."""
    root, seen = tmp_path / "vault", []
    make(root, ["a.md", ".git/x.md"])
    (root / "a.md").write_text("[[b]]")

    def run():
        w = VaultWatch(spark, lambda df, e: seen.append({tuple(r) for r in df.filter("event <> 'index_updated'").collect()}), str(tmp_path / "w"), 4)
        writer = scan_stream(spark, str(root), str(tmp_path / "scans")).writeStream.foreachBatch(w.batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q = writer.start()
        assert q.awaitTermination(120)

    run()
    assert seen == [{("page_added", "a", None), ("link_added", "a", "b"), ("orphan_gained", "a", None), ("dead_gained", "a", "b")}]
    run()
    assert len(seen) == 1
    (root / "b.md").write_text("hi")
    time.sleep(0.02)
    run()
    assert seen[1] == {("page_added", "b", None), ("dead_resolved", "a", "b")}
    (root / "a.md").unlink()
    run()
    assert seen[2] == {("page_removed", "a", None), ("link_removed", "a", "b"), ("orphan_resolved", "a", None), ("orphan_gained", "b", None)}
    assert len(list((tmp_path / "scans").iterdir())) <= 2
