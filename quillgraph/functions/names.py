"""Names, slugs, predicates and references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a predicate: snake case, or prefix:localName.
SNAKE = r"^[a-z][a-z0-9_]*$"
CURIE = r"^[a-z][a-z0-9]*:[A-Za-z][A-Za-z0-9_-]*$"


def normalize_name(c: Column) -> Column:
    return F.translate(F.lower(c), "-_", "  ")


def page_name(path: Column) -> Column:
    """The file's name without its ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def page_slug(path: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?<=[^/])\.[^./]*$", "")), F.lit(" "), F.lit("-"))


def heading_slug(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, joined by dashes."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def link_fragment(target: Column) -> Column:
    """`#slug` of a target's heading; empty without one and for block references."""
    whole = F.when(target.contains("#"), F.trim(F.substring(target, F.locate("#", target) + 1, F.length(target)))).otherwise("")
    slug = heading_slug(whole)
    return F.when(whole.startswith("^") | (slug == ""), "").otherwise(F.concat(F.lit("#"), slug))


def auto_label(predicate: Column) -> Column:
    """snake_case becomes a phrase with a capital; a prefixed name keeps its local part as it is."""
    local = F.when(predicate.contains(":"), F.substring(predicate, F.locate(":", predicate) + 1, F.length(predicate))).otherwise(predicate)
    spaced = F.translate(local, "_-", "  ")
    first = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))
    return F.when(predicate.contains(":"), spaced).otherwise(first)


def display_label(predicate: Column, labels: dict[str, str]) -> Column:
    """The configured label, else the automatic one."""
    if not labels:
        return auto_label(predicate)
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.element_at(known, predicate), auto_label(predicate))


def is_snake(c: Column) -> Column:
    return c.rlike(SNAKE)


def is_curie(c: Column) -> Column:
    return c.rlike(CURIE)


def is_valid_predicate(c: Column) -> Column:
    return is_snake(c) | is_curie(c)


def vocabulary_state(predicate: Column, states: dict[str, str] | None) -> Column:
    """`emergent` without a vocabulary or for what it doesn't list, else its state there."""
    if not states:
        return F.lit("emergent")
    known = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    return F.coalesce(F.element_at(known, predicate), F.lit("emergent"))


def source_ref_class(c: Column) -> Column:
    linked = c.startswith("[[") & c.endswith("]]")
    return (
        F.when(linked & c.contains("^"), "cross_file").when(linked, "page").when(c.startswith("^"), "local").when(c.rlike(r"^[0-9A-Fa-f]{8,}$"), "hash").otherwise("unknown")
    )


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """A glob as an anchored regular expression; `*` crosses slashes unless told not to, `**` always does."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append(".*" if crosses else "[^/]*")
        elif c == "?":
            out.append("." if crosses else "[^/]")
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(_plain(x) for x in pattern[i + 1 : end].split(",")) + ")")
            i = end
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(_plain(c))
        i += 1
    return "^" + "".join(out) + "$"


def _plain(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|()[]{}*+?" else c for c in text)


def glob(c: Column, pattern: str, crosses: bool = True) -> Column:
    return c.rlike(glob_regex(pattern, crosses))


def path_glob(path: Column, pattern: str) -> Column:
    """As in searches: a trailing slash means everything below."""
    return glob(path, pattern + "**" if pattern.endswith("/") else pattern)


def literal_matches(literal: Column, pattern: str) -> Column:
    """Without `*` and `?` the pattern is a part of the literal, else it is the whole."""
    if not any(c in pattern for c in "*?"):
        return literal.contains(pattern)
    return literal.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else _plain(c) for c in pattern) + "$")


def block_id(text: Column) -> Column:
    """The trailing ` ^id` of a block, else null."""
    return F.nullif(F.regexp_extract(F.rtrim(text), r" \^([A-Za-z0-9-]+)$", 1), F.lit(""))


def line_kind(line: Column) -> Column:
    """What a Markdown line starts."""
    bare = F.ltrim(line)
    return (
        F.when(bare == "", "blank").when(bare.rlike(r"^#{1,6}\s"), "heading").when(bare.rlike(r"^(```|~~~)"), "fence").when(bare.rlike(r"^(?:-{3,}|\*{3,}|_{3,})\s*$"), "rule")
        .when(bare.startswith(">"), "quote").when(bare.rlike(r"^[-*+]\s+\[[ xX]\]\s"), "task").when(bare.rlike(r"^[-*+]\s"), "bullet").when(bare.rlike(r"^\d+[.)]\s"), "ordered").otherwise("paragraph")
    )


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def item_id(slug: Column, host: Column, year: Column, product: str) -> Column:
    """A tag URI: host and year, then the product's name space and the slug."""
    return F.format_string("tag:%s,%s:%s/%s", host, year.cast("string"), F.lit(product), slug)


def version_satisfies(version: Column, wanted: str) -> Column:
    """Whether a version `a.b.c` meets all terms of a range: >=, >, <=, <, =, ^ and ~; missing parts are 0."""

    def triple(c: Column) -> Column:
        parts = F.split(F.regexp_extract(F.trim(c), r"^v?(\d+(?:\.\d+){0,2})", 1), r"\.")
        return F.struct(*(F.coalesce(F.get(parts, F.lit(i)).cast("int"), F.lit(0)).alias(n) for i, n in enumerate("abc")))

    def fixed(v: tuple[int, int, int]) -> Column:
        return F.struct(*(F.lit(x).alias(n) for x, n in zip(v, "abc", strict=True)))

    import re

    have, ok = triple(version), F.lit(True)
    for op, text in re.findall(r"(>=|<=|>|<|=|\^|~)?\s*v?(\d+(?:\.\d+){0,2})", wanted):
        given = [int(x) for x in text.split(".")]
        v = tuple([*given, 0, 0][:3])
        at = fixed(v)
        if op == "^":
            top = (v[0] + 1, 0, 0) if v[0] else (0, v[1] + 1, 0) if v[1] else (0, 0, v[2] + 1)
            ok = ok & (have >= at) & (have < fixed(top))
        elif op == "~":
            top = (v[0], v[1] + 1, 0) if len(given) > 1 else (v[0] + 1, 0, 0)
            ok = ok & (have >= at) & (have < fixed(top))
        else:
            ok = ok & {">=": have >= at, "<=": have <= at, ">": have > at, "<": have < at}.get(op, have == at)
    return ok


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """The line and column, from 1, of a character that has `offset` before it; beyond the end, those of the end."""
    before = F.substring(text, F.lit(1), F.least(offset, F.char_length(text)))
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.char_length(F.substring_index(before, "\n", -1)) + 1


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """The characters before a line and column; null for a place that the text doesn't have."""
    rows = F.split(text, "\n")
    before = F.char_length(F.array_join(F.slice(rows, F.lit(1), F.greatest(line - 1, F.lit(0))), "\n")) + F.when(line > 1, 1).otherwise(0)
    here = F.get(rows, line - 1)
    return F.when((line >= 1) & (column >= 1) & (column <= F.char_length(here) + 1), before + column - 1)
