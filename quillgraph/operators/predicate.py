"""The metadata predicate language, compiled to column expressions.

    expr := or; or := and ("||" and)*; and := not ("&&" not)*; not := "!" not | cmp
    cmp  := path op literal | path "contains" literal | path "matches" string | path "is" ["not"] "null" | path | "(" expr ")"
    path := name ("." name | "[" integer "]")*; literal := string | number | true | false | null

The data is JSON. Values of different types are never equal and never ordered; a missing path is null: `!=` holds for
it unless the literal is null, orders don't. Logic has two values, so every leaf is made true or false before `!`.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_token = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op>\|\||&&|==|!=|<=|>=|<|>|!|\(|\)|\[|\]|\.)|(?P<name>[A-Za-z_][A-Za-z0-9_-]*))""")
ORDERS = ("<", "<=", ">", ">=")


class PredicateError(ValueError):
    pass


def lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _token.match(source, at)
        if not m:
            raise PredicateError(f"not understood at {at}: {source[at : at + 20]}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.at = lex(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> bool:
        kind, text = self.peek()
        if kind in ("op", "name") and text in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise PredicateError(f"expected {text}, found {self.peek()[1] or 'the end'}")

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise PredicateError(f"unexpected {self.peek()[1]}")
        return tree

    def chain(self, part, sign: str, name: str):
        parts = [part()]
        while self.take(sign):
            parts.append(part())
        return parts[0] if len(parts) == 1 else (name, parts)

    def either(self):
        return self.chain(self.all_of, "||", "or")

    def all_of(self):
        return self.chain(self.negated, "&&", "and")

    def negated(self):
        return ("not", self.negated()) if self.take("!") else self.compared()

    def compared(self):
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        path = self.path()
        for op in ("==", "!=", *ORDERS):
            if self.take(op):
                return ("compare", path, op, self.literal())
        if self.take("contains"):
            return ("contains", path, self.literal())
        if self.take("matches"):
            value = self.literal()
            if not isinstance(value, str):
                raise PredicateError("matches needs a string")
            return ("matches", path, value)
        if self.take("is"):
            no = self.take("not")
            self.need("null")
            return ("is_not_null" if no else "is_null", path)
        return ("flag", path)

    def path(self) -> tuple:
        kind, text = self.peek()
        if kind != "name":
            raise PredicateError(f"expected a path, found {text or 'the end'}")
        self.at += 1
        steps: list = [text]
        while True:
            if self.take("."):
                kind, text = self.peek()
                if kind != "name":
                    raise PredicateError("expected a name after .")
                self.at += 1
                steps.append(text)
            elif self.take("["):
                kind, text = self.peek()
                if kind != "num" or not re.fullmatch(r"-?\d+", text):
                    raise PredicateError("expected an index")
                self.at += 1
                self.need("]")
                steps.append(int(text))
            else:
                return tuple(steps)

    def literal(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            return json.loads('"' + text[1:-1].replace('"', '\\"') + '"') if text[0] == "'" else json.loads(text)
        if kind == "num":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "name" and text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text]
        raise PredicateError(f"expected a literal, found {text or 'the end'}")


def parse(source: str):
    return _Parser(source).whole()


def _get(data: Column, path: tuple) -> Column:
    """The variant at a path; null if it is missing."""
    at = data
    for step in path:
        if isinstance(step, str):
            at = F.try_variant_get(at, f"$['{step}']", "variant")
        elif step >= 0:
            at = F.try_variant_get(at, f"$[{step}]", "variant")
        else:
            at = F.get(F.try_variant_get(at, "$", "array<variant>"), F.size(F.try_variant_get(at, "$", "array<variant>")) + step)
    return at


def _kind(v: Column) -> Column:
    """string, number, bool, null, array, object; null for what is missing."""
    of = F.schema_of_variant(v)
    return (
        F.when(of == "STRING", "string").when(of == "BOOLEAN", "bool").when(of.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)"), "number").when(of == "VOID", "null").when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object")
    )


def _same(v: Column, literal) -> Column:
    kind = _kind(v)
    if literal is None:
        return F.coalesce(kind == "null", F.lit(True))
    if isinstance(literal, bool):
        return F.coalesce((kind == "bool") & (F.try_variant_get(v, "$", "boolean") == literal), F.lit(False))
    if isinstance(literal, str):
        return F.coalesce((kind == "string") & (F.try_variant_get(v, "$", "string") == literal), F.lit(False))
    return F.coalesce((kind == "number") & (F.try_variant_get(v, "$", "double") == float(literal)), F.lit(False))


def _build(tree, data: Column) -> Column:
    name, *rest = tree
    if name in ("and", "or"):
        out = _build(rest[0][0], data)
        for part in rest[0][1:]:
            out = out & _build(part, data) if name == "and" else out | _build(part, data)
        return out
    if name == "not":
        return ~_build(rest[0], data)
    v = _get(data, rest[0])
    kind = _kind(v)
    if name == "compare":
        op, literal = rest[1:]
        if op == "==":
            return _same(v, literal)
        if op == "!=":
            return ~_same(v, literal)
        if isinstance(literal, (bool, type(None))):
            return F.lit(False)
        have, want = (F.try_variant_get(v, "$", "string"), "string") if isinstance(literal, str) else (F.try_variant_get(v, "$", "double"), "number")
        tested = {"<": have < literal, "<=": have <= literal, ">": have > literal, ">=": have >= literal}[op]
        return F.coalesce((kind == want) & tested, F.lit(False))
    if name == "contains":
        literal = rest[1]
        inside = F.exists(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _same(x, literal))
        part = F.try_variant_get(v, "$", "string").contains(literal) if isinstance(literal, str) else F.lit(False)
        return F.coalesce(F.when(kind == "array", inside).when(kind == "string", part), F.lit(False))
    if name == "matches":
        return F.coalesce((kind == "string") & F.try_variant_get(v, "$", "string").rlike(rest[1]), F.lit(False))
    if name == "is_null":
        return F.coalesce(kind == "null", F.lit(True))
    if name == "is_not_null":
        return ~F.coalesce(kind == "null", F.lit(True))
    return F.coalesce((kind == "bool") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def compile(source: str, json_col: Column) -> Column:  # noqa: A001
    """The predicate over a column of JSON text, as a Boolean that is never null."""
    return _build(parse(source), F.try_parse_json(json_col))


def selector(include: list[str], exclude: list[str] = (), where: str | None = None, probes: list[str] = (), probe_all: bool = False, path: str = "path", metadata: str = "frontmatter", text: str = "content"):
    """A filter in three layers, cheap ones first: globs of the path, the predicate, then probes of the text.

    A probe is a part of the text, or a regular expression after `re:`; any, or all, must hit.
    """
    from ..functions.names import glob

    def apply(df):
        some = F.lit(False)
        for g in include:
            some = some | glob(F.col(path), g)
        for g in exclude:
            some = some & ~glob(F.col(path), g)
        df = df.filter(some)
        if where:
            df = df.filter(compile(where, F.col(metadata)))
        if probes:
            hits = [F.col(text).rlike(p[3:]) if p.startswith("re:") else F.col(text).contains(p) for p in probes]
            one = hits[0]
            for h in hits[1:]:
                one = one & h if probe_all else one | h
            df = df.filter(F.coalesce(one, F.lit(False)))
        return df

    return apply


def coverage(pages, hooks: dict):
    """(hook, matched, total) for hooks by name, each a selector."""
    total = pages.count()
    out = None
    for name, select in hooks.items():
        one = select(pages).agg(F.count("*").alias("matched")).select(F.lit(name).alias("hook"), "matched", F.lit(total).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
