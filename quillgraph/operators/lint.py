"""Lints of the predicate vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_curie

#: How much commoner the other spelling must be, how near it must be, and the share that is too much.
ASYMMETRY, NEAR, OVERUSE = 5, 2, 0.5


@dataclass
class Vocabulary:
    """Declared predicates with their labels and prefixes. Its size is that of a configuration file."""

    labels: dict[str, str | None] = field(default_factory=dict)
    maps_to: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    states: dict[str, str] = field(default_factory=dict)
    enforce: bool = False
    accept_is_a: bool = False

    @classmethod
    def from_toml(cls, text: str) -> Vocabulary:
        import tomllib

        raw = tomllib.loads(text)
        own = raw.get("predicates", {})
        return cls(
            labels={k: (v.get("label") if isinstance(v, dict) else None) for k, v in own.items()},
            maps_to={k: v["maps_to"] for k, v in own.items() if isinstance(v, dict) and v.get("maps_to")},
            prefixes=dict(raw.get("prefixes", {})),
            states={k: v["state"] for k, v in own.items() if isinstance(v, dict) and v.get("state")},
            enforce=bool(raw.get("enforce", False)),
            accept_is_a=bool(raw.get("accept_is_a", False)),
        )


def frequencies(uses: DataFrame) -> DataFrame:
    """(predicate, n, file, line): how often each is used in uses(file, line, predicate), and where first."""
    return uses.groupBy("predicate").agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("f")).select("predicate", "n", F.col("f.file").alias("file"), F.col("f.line").alias("line"))


def spelling_drift(uses: DataFrame) -> DataFrame:
    """(predicate, n, other, other_n, file, line): a rare predicate near a much commoner one, the first of these in order.

    Predicates are compared by pairs of a vocabulary, which is small; its lengths must be near, which is an equi-join.
    """
    freq = frequencies(uses)
    q = freq.select(F.col("predicate").alias("other"), F.col("n").alias("other_n"), F.explode(F.sequence(F.length("predicate") - NEAR, F.length("predicate") + NEAR)).alias("len"))
    p = freq.withColumn("len", F.length("predicate"))
    hit = p.join(q, "len").filter((F.col("predicate") != F.col("other")) & (F.col("other_n") >= ASYMMETRY * F.col("n"))).filter(F.levenshtein("predicate", "other") <= NEAR)
    first = hit.groupBy("predicate", "n", "file", "line").agg(F.min(F.struct("other", "other_n")).alias("o"))
    return first.select("predicate", "n", F.col("o.other").alias("other"), F.col("o.other_n").alias("other_n"), "file", "line")


def overuse(uses: DataFrame, predicate: str = "relates_to") -> DataFrame:
    """(file, used, typed, line): files where more than half of two or more typed links say no more than `relates_to`."""
    own = F.col("predicate") == predicate
    return uses.groupBy("file").agg(F.count_if(own).alias("used"), F.count("*").alias("typed"), F.min(F.when(own, F.col("line"))).alias("line")).filter((F.col("typed") >= 2) & (F.col("used") > F.col("typed") * OVERUSE))


def nearest_declared(uses: DataFrame, declared: list[str]) -> DataFrame:
    """uses with `near`: the declared predicate nearest to each, at most two edits away, the first of ties; else null."""
    best = None
    for d in sorted(declared):
        away = F.levenshtein("predicate", F.lit(d))
        one = F.when((away <= NEAR) & (F.col("predicate") != d), F.struct(away.alias("away"), F.lit(d).alias("name")))
        best = one if best is None else F.least(best, one)
    return uses.withColumn("near", best["name"] if best is not None else F.lit(None).cast("string"))


def lints(uses: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(file, line, kind, level, message) of uses(file, line, predicate), all five kinds."""
    v = vocabulary
    row = lambda kind, level, message, df: df.select("file", "line", F.lit(kind).alias("kind"), F.lit(level).alias("level"), message.alias("message"))
    quoted = F.concat(F.lit("`"), F.col("predicate"), F.lit("::`"))
    out = []
    if not (v and v.accept_is_a):
        out.append(row("predicate-prefer-conforms-to", "warning", F.lit("`is_a::` asserts identity; prefer `conforms_to::`"), uses.filter("predicate = 'is_a'")))
    if v:
        strange = nearest_declared(uses.filter(~F.col("predicate").isin(list(v.labels))), list(v.labels))
        hint = F.coalesce(F.concat(F.lit(" (did you mean `"), F.col("near"), F.lit("`?)")), F.lit(""))
        out.append(row("predicate-undeclared", "error" if v.enforce else "warning", F.concat(quoted, F.lit(" is not declared"), hint), strange))
    prefix = F.split("predicate", ":")[0]
    curies = uses.filter(is_curie(F.col("predicate")) & ~prefix.isin(list(v.prefixes) if v else []))
    out.append(row("predicate-undeclared-prefix", "info", F.concat(F.lit("prefix `"), prefix, F.lit(":` is not declared")), curies))
    out.append(row("predicate-drift", "warning", F.concat(F.lit("`"), F.col("predicate"), F.lit("` ("), F.col("n").cast("string"), F.lit(") is close to `"), F.col("other"), F.lit("` ("), F.col("other_n").cast("string"), F.lit(")")), spelling_drift(uses)))
    out.append(row("predicate-relates-to-overuse", "info", F.concat(F.lit("`relates_to::` is "), F.col("used").cast("string"), F.lit("/"), F.col("typed").cast("string"), F.lit(" of this page's typed links")), overuse(uses)))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.orderBy("file", "line", "kind", "message")


def tags_to_predicates(tags: DataFrame, pages: DataFrame, predicate: str = "in_domain") -> DataFrame:
    """(source, predicate, target): tags(page, tag) that name a page by its normalised name or slug."""
    norm = lambda c: F.translate(F.lower(c), "-_", "  ")
    keys = pages.select("page", norm(F.col("page")).alias("k")).unionByName(pages.select("page", norm(F.col("slug")).alias("k"))).groupBy("k").agg(F.min("page").alias("target"))
    return tags.select(F.col("page").alias("source"), norm(F.col("tag")).alias("k")).join(keys, "k").select("source", F.lit(predicate).alias("predicate"), "target").distinct().orderBy("source", "target")
