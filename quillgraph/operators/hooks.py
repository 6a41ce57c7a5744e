"""User functions on pages: stages of text, tree and HTML transforms, with statistics and shared results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import table

#: Stages in order: text before parsing, the document tree, rendered HTML.
STAGES = ("pre_parse", "transform", "post_render")


@dataclass
class Hook:
    """A function of (value, page) that returns the value's successor, and may emit(key, value) for all pages to see."""

    name: str
    stage: str
    run: Callable
    off_key: str | None = None


@dataclass
class Context:
    path: str
    metadata: dict
    emitted: list = field(default_factory=list)

    def emit(self, key: str, value) -> None:
        self.emitted.append((key, json.dumps(value, sort_keys=True)))


OUT = "path string, content string, failed array<string>, ran array<string>, emitted array<struct<ext:string,key:string,value:string>>"


def run_stage(pages: DataFrame, hooks: list[Hook], stage: str) -> DataFrame:
    """OUT of pages(path, content, frontmatter): the hooks of a stage one after another.

    A hook that fails leaves the value as it was and its own emissions out, and is listed as failed. A page turns one
    off by `off_key: false` in its metadata. Trees are values of JSON text.
    """
    own = [h for h in hooks if h.stage == stage]

    def one(path: str, value: str, meta: str | None) -> tuple:
        page = Context(path, json.loads(meta or "{}"))
        ran, failed, shared = [], [], []
        for h in own:
            if h.off_key and page.metadata.get(h.off_key) is False:
                continue
            page.emitted = []
            try:
                out = h.run(json.loads(value) if stage == "transform" else value, page)
                value = json.dumps(out, sort_keys=True) if stage == "transform" else str(out)
                shared += [{"ext": h.name, "key": k, "value": v} for k, v in page.emitted]
                ran.append(h.name)
            except Exception:  # whatever a user's function raises concerns this page and hook only
                failed.append(h.name)
        return path, value, failed, ran, shared

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(*r) for r in zip(b["path"], b["content"], b["frontmatter"], strict=True)], columns=["path", "content", "failed", "ran", "emitted"])

    return pages.select("path", "content", "frontmatter").mapInPandas(run, OUT)


def run_pipeline(pages: DataFrame, hooks: list[Hook], parse: Callable[[str], object], render: Callable[[object], str]) -> DataFrame:
    """(path, html, stats, emitted) of pages(path, content, frontmatter): all three stages, each in one pass over its input.

    Text hooks see the text, `parse` makes its tree, tree hooks change it, `render` makes HTML and the last hooks change
    that. stats has an entry (stage, hook, ran, failed) for each hook that a page didn't turn off.
    """

    def step(f: Callable, load: bool, dump: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = [f(json.loads(v) if load else v) for v in b["content"]]
                b["content"] = [json.dumps(m, sort_keys=True) for m in made] if dump else made
                yield b

        return run

    carried = "path string, content string, frontmatter string, stats array<struct<stage:string,hook:string,ran:boolean,failed:boolean>>, emitted array<struct<ext:string,key:string,value:string>>"
    now = pages.select("path", "content", "frontmatter", F.expr("cast(array() as array<struct<stage:string,hook:string,ran:boolean,failed:boolean>>)").alias("stats"), F.expr("cast(array() as array<struct<ext:string,key:string,value:string>>)").alias("emitted"))
    for stage, after in zip(STAGES, (step(parse, False, True), step(render, True, False), None), strict=True):
        now = table(now, "stage")
        out = run_stage(now, hooks, stage)
        mark = lambda names, ok: F.transform(names, lambda n: F.struct(F.lit(stage).alias("stage"), n.alias("hook"), F.lit(ok).alias("ran"), F.lit(not ok).alias("failed")))  # noqa: B023, E731
        told = out.select("path", F.col("content").alias("_c"), F.concat(mark("ran", True), mark("failed", False)).alias("_s"), F.col("emitted").alias("_e"))
        now = now.join(told, "path").select("path", F.col("_c").alias("content"), "frontmatter", F.concat("stats", "_s").alias("stats"), F.concat("emitted", "_e").alias("emitted"))
        if after:
            now = now.mapInPandas(after, carried)
    return now.select("path", F.col("content").alias("html"), "stats", "emitted")


def hook_statistics(done: DataFrame) -> DataFrame:
    """(stage, hook, ran, failed): how many pages each hook ran on and failed on."""
    return done.select(F.explode("stats").alias("s")).groupBy("s.stage", "s.hook").agg(F.count_if("s.ran").alias("ran"), F.count_if("s.failed").alias("failed"))
