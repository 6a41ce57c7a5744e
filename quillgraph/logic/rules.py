"""The rule language: facts, strict and defeasible rules, defeaters, preferences.

    (given lit)  (always label? body head)  (normally label? body head)  (except label? body head)
    (prefer r1 r2 ...)  (meta label ...)  (claims source ... facts and rules)  ; comment

A literal is a name or a list such as `(owner "ann")`, which is opaque: it is written out in one way and compared as
text. `(not x)` is `~x`. A body is a literal or `(and ...)`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_snake
from ..scratch import table

_token = re.compile(r"\s*(?:;[^\n]*|(\()|(\))|(\"(?:[^\"\\]|\\.)*\")|([^\s()\";]+))")
KINDS = {"always": "strict", "normally": "defeasible", "except": "defeater"}


class RuleError(ValueError):
    pass


def read(text: str) -> list[tuple[list, int]]:
    """The expressions of a text, each with its line."""
    stack, out, at, line = [], [], 0, 1
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            if text[at:].strip():
                raise RuleError(f"line {line}: not understood: {text[at : at + 20]}")
            break
        line += text.count("\n", at, max(at, m.start(m.lastindex) if m.lastindex else m.end()))
        if m[1]:
            stack.append(([], line))
        elif m[2]:
            if not stack:
                raise RuleError(f"line {line}: unexpected )")
            done, began = stack.pop()
            stack[-1][0].append(done) if stack else out.append((done, began))
        elif m[3] or m[4]:
            if not stack:
                raise RuleError(f"line {line}: {m[0].strip()} outside an expression")
            stack[-1][0].append(m[3] or m[4])
        line += text.count("\n", m.start(m.lastindex) if m.lastindex else m.end(), m.end())
        at = m.end()
    if stack:
        raise RuleError(f"line {stack[-1][1]}: unclosed (")
    return out


def literal(x) -> str:
    if isinstance(x, str):
        return x
    if x and x[0] == "not":
        inner = literal(x[1])
        return inner[1:] if inner.startswith("~") else "~" + inner
    return "(" + " ".join(map(literal, x)) + ")"


def negated(lit: str) -> str:
    return lit[1:] if lit.startswith("~") else "~" + lit


def statements(text: str, first_line: int = 1) -> Iterator[dict]:
    """kind, label, head, body, line of each statement; superiority has pairs in body."""
    def one(x: list, line: int) -> Iterator[dict]:
        if not x or not isinstance(x[0], str):
            raise RuleError(f"line {line}: no statement")
        name, *args = x
        at = {"line": first_line + line - 1}
        if name == "given" and len(args) == 1:
            yield {"kind": "fact", "label": None, "head": literal(args[0]), "body": [], **at}
        elif name in KINDS and len(args) in (2, 3):
            label, body, head = args if len(args) == 3 else (None, *args)
            parts = body[1:] if isinstance(body, list) and body and body[0] == "and" else [body]
            yield {"kind": KINDS[name], "label": label, "head": literal(head), "body": [literal(p) for p in parts], **at}
        elif name == "prefer" and len(args) > 1:
            for a, b in zip(args, args[1:], strict=False):
                yield {"kind": "prefer", "label": None, "head": None, "body": [a, b], **at}
        elif name == "claims":
            for p in args[1:]:
                if isinstance(p, list):
                    yield from one(p, line)
        elif name != "meta":
            raise RuleError(f"line {line}: unknown statement {name}")

    for x, line in read(text):
        yield from one(x, line)


STATEMENT = "path string, page string, block int, ord int, kind string, label string, head string, body array<string>, line int, error string"


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """STATEMENT of blocks(path, page, ord, start_line, content); a block that can't be parsed is one row with an error."""

    def run(batches):
        for b in batches:
            rows = []
            for path, page, block, start, text in zip(b["path"], b["page"], b["ord"], b["start_line"], b["content"], strict=True):
                try:
                    rows += [(path, page, block, i, s["kind"], s["label"], s["head"], s["body"], s["line"], None) for i, s in enumerate(statements(text, int(start) + (0 if path.endswith(".spl") else 1)))]
                except RuleError as e:
                    rows.append((path, page, block, 0, "error", None, None, [], start, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATEMENT.split(", ")])

    return blocks.select("path", "page", "ord", "start_line", "content").mapInPandas(run, STATEMENT)


class Theory:
    """rules(label, kind, head, path, line, page), body(label, pos, literal), facts(label, literal, path, line, page),
    superiority(superior, inferior), errors(path, line, message), duplicates(label, n).

    Rules without a label, and facts, get one from where they stand. Of rules with one label the first, by file and
    line, is kept.
    """

    def __init__(self, said: DataFrame, edge_facts: DataFrame | None = None):
        name = lambda prefix: F.concat_ws(":", F.lit(prefix), "path", F.col("block").cast("string"), F.col("ord").cast("string"))
        spot = F.struct("path", "line", "block", "ord")
        rules = said.filter(F.col("kind").isin(*KINDS.values())).withColumn("label", F.coalesce("label", name("__rule")))
        kept = rules.groupBy("label").agg(F.min_by(F.struct("kind", "head", "body", "path", "line", "page"), spot).alias("r"), F.count("*").alias("n"))
        self.rules = kept.select("label", "r.kind", "r.head", "r.path", "r.line", "r.page")
        self.body = kept.select("label", F.posexplode("r.body").alias("pos", "literal"))
        self.duplicates = kept.filter("n > 1").select("label", "n")
        own = said.filter("kind = 'fact'").select(name("__fact").alias("label"), F.col("head").alias("literal"), "path", "line", "page")
        self.facts = own.unionByName(edge_facts) if edge_facts is not None else own
        self.superiority = said.filter("kind = 'prefer'").select(F.col("body")[0].alias("superior"), F.col("body")[1].alias("inferior")).distinct()
        self.errors = said.filter("kind = 'error'").select("path", "line", F.col("error").alias("message"))

    @classmethod
    def of_blocks(cls, blocks: DataFrame, edge_facts: DataFrame | None = None) -> Theory:
        """The blocks are parsed here, once: all parts of the theory are read from the written statements."""
        return cls(table(parse_blocks(blocks), "said"), edge_facts)

    def problems(self) -> DataFrame:
        """(kind, what): labels in preferences that no rule has, and body literals that nothing concludes."""
        labels = self.superiority.select(F.explode(F.array("superior", "inferior")).alias("label")).distinct()
        heads = self.rules.select(F.col("head").alias("literal")).unionByName(self.facts.select("literal")).distinct()
        loose = self.body.select("literal").distinct().join(heads, "literal", "left_anti")
        return labels.join(self.rules.select("label"), "label", "left_anti").select(F.lit("undefined_label").alias("kind"), F.col("label").alias("what")).unionByName(loose.select(F.lit("unsupported_literal").alias("kind"), F.col("literal").alias("what")))


def edge_facts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts `(predicate "source" "target")` of links with a plain predicate, placed in the first file of their source."""
    first = pages.groupBy(F.col("page").alias("source")).agg(F.min("path").alias("path"))
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lit = F.concat(F.lit("("), F.col("predicate"), F.lit(" "), q("source"), F.lit(" "), q("target"), F.lit(")"))
    own = edges.filter(is_snake(F.col("predicate"))).join(first, "source", "left")
    return own.select(F.concat(F.lit("__edge_fact:"), lit, F.lit(":"), F.col("line").cast("string")).alias("label"), lit.alias("literal"), "path", F.col("line").cast("int").alias("line"), F.col("source").alias("page"))


def same_blocks(cached: DataFrame, current: DataFrame) -> bool:
    """Whether a cached theory still holds: the same rule blocks (key, ast_hash) in both."""
    both = cached.select("key", F.col("ast_hash").alias("a")).join(current.select("key", F.col("ast_hash").alias("b")), "key", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


PARTS = ("rules", "body", "facts", "superiority", "errors", "duplicates")


def save_theory(theory: Theory, blocks: DataFrame, path: str) -> None:
    """Keep a theory as tables, with the keys and hashes of the rule blocks that it was built from: blocks(key, ast_hash)."""
    for name in PARTS:
        getattr(theory, name).write.mode("overwrite").parquet(f"{path}/{name}")
    blocks.select("key", "ast_hash").write.mode("overwrite").parquet(f"{path}/blocks")


def load_theory(spark: SparkSession, path: str, blocks: DataFrame, edges: DataFrame) -> Theory | None:
    """The theory kept at path, or None if a rule block changed or any link has a predicate, whose facts it lacks."""
    if not edges.filter("predicate is not null").isEmpty() or not same_blocks(spark.read.parquet(f"{path}/blocks"), blocks):
        return None
    theory = Theory.__new__(Theory)
    for name in PARTS:
        setattr(theory, name, spark.read.parquet(f"{path}/{name}"))
    return theory
