"""What is asked of the conclusions of defeasible reasoning.

The propositional proof theory with ambiguity blocking: +D and -D are what strict rules prove and cannot prove, +d and
-d what holds and fails defeasibly. Tags only grow, each derived from others, until nothing more follows; so cyclic
literals get no tag. `parts` finds them.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import literal_matches
from ..scratch import table
from .parts import TAGS, conclusions, negate, revised  # noqa: F401
from .rules import Theory


def strongest(found: DataFrame) -> DataFrame:
    """(literal, tag): one tag each, +D before +d before -D before -d."""
    rank = F.when(F.col("tag") == "+D", 0).when(F.col("tag") == "+d", 1).when(F.col("tag") == "-D", 2).otherwise(3)
    return found.groupBy("literal").agg(F.min_by("tag", rank).alias("tag"))


def status(found: DataFrame, positive: bool | None = None, definite: bool | None = None, pattern: str | None = None) -> DataFrame:
    """Conclusions by sign, by strength and by a literal's pattern; all that are given must hold."""
    if positive is not None:
        found = found.filter(F.col("tag").startswith("+" if positive else "-"))
    if definite is not None:
        found = found.filter(F.col("tag").endswith("D" if definite else "d"))
    return found.filter(literal_matches(F.col("literal"), pattern)) if pattern else found


def summary(theory: Theory, found: DataFrame) -> DataFrame:
    """One row: facts, rules by kind, preferences, conclusions by tag, files."""
    r = theory.rules.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_rules") for k in ("strict", "defeasible", "defeater")))
    c = found.agg(*(F.count_if(F.col("tag") == t).alias(n) for t, n in zip(TAGS, ("definitely_provable", "definitely_not_provable", "defeasibly_provable", "defeasibly_not_provable"), strict=True)))
    files = theory.rules.select("path").unionByName(theory.facts.select("path")).agg(F.count_distinct("path").alias("files"))
    return theory.facts.agg(F.count("*").alias("facts")).crossJoin(r).crossJoin(theory.superiority.agg(F.count("*").alias("superiority"))).crossJoin(c).crossJoin(files)


def conflicts(theory: Theory) -> DataFrame:
    """(literal, for_rule, against_rule): pairs of rules for a literal and its negation that nothing decides.

    A literal isn't in conflict if rules of exactly one side are strict, or if each pair of its defeasible rules has a
    preference either way.
    """
    own = theory.rules.filter("kind <> 'defeater'").select("label", "kind", "head")
    plus, minus = own.filter(~F.col("head").startswith("~")), own.filter(F.col("head").startswith("~"))
    pairs = plus.select(F.col("head").alias("literal"), F.col("label").alias("for_rule"), (F.col("kind") == "strict").alias("fs")).join(minus.select(negate(F.col("head")).alias("literal"), F.col("label").alias("against_rule"), (F.col("kind") == "strict").alias("as")), "literal")
    sides = pairs.groupBy("literal").agg(F.bool_or("fs").alias("f"), F.bool_or("as").alias("a")).filter("f = a").select("literal")
    soft = pairs.join(sides, "literal", "left_semi")
    decided = theory.superiority.select(F.col("superior").alias("for_rule"), F.col("inferior").alias("against_rule")).unionByName(theory.superiority.select(F.col("inferior").alias("for_rule"), F.col("superior").alias("against_rule"))).distinct()
    return soft.join(decided, ["for_rule", "against_rule"], "left_anti").select("literal", "for_rule", "against_rule")


def why_not(theory: Theory, found: DataFrame, literal: str) -> DataFrame:
    """(rule, blocker, what): for each rule for the literal, body literals that don't hold, and what defeats it."""
    good = found.filter(F.col("tag").isin("+D", "+d")).select("literal").distinct()
    cand = theory.rules.filter((F.col("head") == literal) & (F.col("kind") != "defeater"))
    failed = cand.select("label").join(theory.body, "label").join(good, "literal", "left_anti").select(F.col("label").alias("rule"), F.lit("failed_body").alias("blocker"), F.col("literal").alias("what"))
    lacking = theory.body.join(good, "literal", "left_anti").select("label").distinct()
    foes = theory.rules.filter(negate(F.col("head")) == literal).join(lacking, "label", "left_anti")
    beaten = cand.select(F.col("label").alias("rule")).join(theory.superiority, F.col("rule") == F.col("inferior"), "inner").join(foes.select(F.col("label").alias("what")), F.col("superior") == F.col("what")).select("rule", F.lit("defeated").alias("blocker"), "what")
    defeaters = cand.select(F.col("label").alias("rule")).join(foes.filter("kind = 'defeater'").select(F.col("label").alias("what"), negate(F.col("head")).alias("_h")), F.lit(literal) == F.col("_h")).select("rule", F.lit("defeated").alias("blocker"), "what")
    return failed.unionByName(beaten).unionByName(defeaters).distinct()


def require(theory: Theory, found: DataFrame, literal: str, most: int = 5, rounds: int | None = None) -> DataFrame:
    """(rule, needed, open): for up to `most` rules for the literal, what would have to be given.

    A missing body literal is replaced by the body of the first rule for it, in file and line order, until nothing
    missing has a rule. With a number of rounds, what then still has one is given, too, as open.
    """
    good = found.filter(F.col("tag").isin("+D", "+d")).select("literal").distinct()
    rules = theory.rules.filter("kind <> 'defeater'")
    first = rules.groupBy("head").agg(F.min_by("label", F.struct("path", "line", "label")).alias("sub"))
    cand = rules.filter(F.col("head") == literal).orderBy("path", "line", "label").limit(most).select(F.col("label").alias("rule"))
    front = table(cand.join(theory.body, F.col("rule") == F.col("label")).select("rule", "literal").join(good, "literal", "left_anti").distinct(), "front")
    seen, leaves = front, None
    for done in count(1):
        led = front.join(first, F.col("literal") == F.col("head"), "left")
        ends = led.filter("sub is null").select("rule", F.col("literal").alias("needed"), F.lit(False).alias("open"))
        leaves = ends if leaves is None else leaves.unionByName(ends)
        nxt = led.filter("sub is not null").select("rule", "sub").distinct().join(theory.body, F.col("sub") == F.col("label")).select("rule", "literal").join(good, "literal", "left_anti").join(seen, ["rule", "literal"], "left_anti").distinct()
        front = table(nxt, "front")
        if front.isEmpty():
            break
        if done == rounds:
            leaves = leaves.unionByName(front.select("rule", F.col("literal").alias("needed"), F.lit(True).alias("open")))
            break
        seen = seen.unionByName(front)
    return leaves.distinct()


def explain(theory: Theory, found: DataFrame, literal: str, depth: int | None = None) -> DataFrame:
    """(depth, literal, tag, rule, body): the proof tree of a literal, from the rules whose whole body holds.

    With a depth the tree is cut there: a body literal without a row of its own is further down.
    """
    good = strongest(found.filter(F.col("tag").isin("+D", "+d")))
    bodies = theory.body.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "literal"))).alias("b")).select("label", F.transform("b", lambda x: x["literal"]).alias("body"))
    lacking = theory.body.join(good, "literal", "left_anti").select("label").distinct()
    usable = theory.rules.filter("kind <> 'defeater'").join(lacking, "label", "left_anti").join(bodies, "label", "left").groupBy("head").agg(F.min_by(F.struct("label", "body"), F.struct("path", "line", "label")).alias("r"))
    spark = found.sparkSession
    front = table(spark.createDataFrame([(literal,)], "literal string").join(good, "literal"), "front")
    out = None
    seen = front.select("literal")
    for d in count():
        rows = front.join(usable, F.col("literal") == F.col("head"), "left").select(F.lit(d).alias("depth"), "literal", "tag", F.col("r.label").alias("rule"), F.col("r.body").alias("body"))
        out = rows if out is None else out.unionByName(rows)
        if d == depth:
            break
        front = table(rows.select(F.explode("body").alias("literal")).distinct().join(seen, "literal", "left_anti").join(good, "literal"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("literal"))
    return out


def proof_sources(theory: Theory, found: DataFrame) -> DataFrame:
    """(literal, tag, path, line, page): where the rules and facts behind each provable literal stand."""
    good = strongest(found.filter(F.col("tag").isin("+D", "+d")))
    lacking = theory.body.join(good, "literal", "left_anti").select("label").distinct()
    fired = theory.rules.filter("kind <> 'defeater'").join(lacking, "label", "left_anti")
    by_rule = good.join(fired, F.col("literal") == F.col("head")).select("literal", "tag", "label", "path", "line", "page")
    given = theory.facts.select(F.col("literal").alias("fact"), "path", "line", "page")
    direct = good.join(given, F.col("literal") == F.col("fact")).select("literal", "tag", "path", "line", "page")
    below = by_rule.select("literal", "tag", "label").join(theory.body.select("label", F.col("literal").alias("part")), "label").join(given, F.col("part") == F.col("fact")).select("literal", "tag", "path", "line", "page")
    return by_rule.drop("label").unionByName(direct).unionByName(below).distinct()


def conclusions_by_page(theory: Theory, found: DataFrame) -> DataFrame:
    return proof_sources(theory, found).groupBy("page").agg(F.sort_array(F.collect_set(F.struct("literal", "tag"))).alias("conclusions"))


def what_if(before: DataFrame, after: DataFrame) -> DataFrame:
    """(literal, change, was, now) between two sets of conclusions: new, removed, changed."""
    a, b = strongest(before), strongest(after)
    both = b.withColumnRenamed("tag", "now").join(a.withColumnRenamed("tag", "was"), "literal", "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("literal", kind.alias("change"), "was", "now").filter("change is not null")


def provenance(theory: Theory, found: DataFrame, groundings: DataFrame, baseline: DataFrame) -> DataFrame:
    """proof_sources with `fresh`: whether the section around the source's rule block is as in the baseline."""
    old = baseline.select("path", "start_line", F.col("grounding").alias("_g"))
    spans = groundings.select("path", "start_line", "end_line", "grounding").join(old, ["path", "start_line"], "left")
    src = proof_sources(theory, found)
    hit = src.join(spans.withColumnRenamed("path", "_p"), (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    return hit.select("literal", "tag", "path", "line", "page", F.coalesce(F.col("grounding") == F.col("_g"), F.lit(False)).alias("fresh"))


def export(theory: Theory) -> DataFrame:
    """The theory in the rule language, a statement a row."""
    bodies = theory.body.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "literal"))).alias("b")).select("label", F.transform("b", lambda x: _written(x["literal"])).alias("b"))
    word = F.when(F.col("kind") == "strict", "always").when(F.col("kind") == "defeasible", "normally").otherwise("except")
    text = F.when(F.size("b") == 1, F.col("b")[0]).otherwise(F.concat(F.lit("(and "), F.array_join("b", " "), F.lit(")")))
    rules = theory.rules.join(bodies, "label").select(F.lit(1).alias("k"), F.concat(F.lit("("), word, F.lit(" "), F.col("label"), F.lit(" "), text, F.lit(" "), _written(F.col("head")), F.lit(")")).alias("value"))
    facts = theory.facts.select(F.lit(0).alias("k"), F.concat(F.lit("(given "), _written(F.col("literal")), F.lit(")")).alias("value")).distinct()
    sup = theory.superiority.select(F.lit(2).alias("k"), F.concat(F.lit("(prefer "), F.col("superior"), F.lit(" "), F.col("inferior"), F.lit(")")).alias("value"))
    return facts.unionByName(rules).unionByName(sup).orderBy("k", "value").select("value")


def export_json(theory: Theory, found: DataFrame | None = None) -> DataFrame:
    """(part, value): the theory as JSON objects, one for each fact, rule and preference, one with the summary and, with conclusions, one for each.

    Names and forms are those of the JSON export. A positive conclusion has the places that prove it, sorted.
    """
    make = lambda *columns: F.to_json(F.struct(*columns)).alias("value")
    place = (F.col("path").alias("source_file"), F.col("line").alias("source_line"), F.col("page").alias("source_page"))
    bodies = theory.body.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "literal"))).alias("b")).select("label", F.transform("b", lambda x: x["literal"]).alias("body"))
    facts = theory.facts.select(F.lit("facts").alias("part"), make("literal", *place))
    rules = theory.rules.join(bodies, "label", "left").select(F.lit("rules").alias("part"), make("label", F.initcap("kind").alias("rule_type"), F.coalesce("body", F.array().cast("array<string>")).alias("body"), "head", *place))
    better = theory.superiority.select(F.lit("superiority").alias("part"), make("superior", "inferior"))
    counts = theory.facts.agg(F.count("*").alias("fact_count")).crossJoin(theory.rules.agg(F.count_if(F.col("kind") != "defeater").alias("rule_count"), F.count_if(F.col("kind") == "defeater").alias("defeater_count")))
    counts = counts.crossJoin(theory.superiority.agg(F.count("*").alias("superiority_count"))).crossJoin(theory.rules.select("path").unionByName(theory.facts.select("path")).agg(F.count_distinct("path").alias("source_file_count")))
    out = facts.unionByName(rules).unionByName(better).unionByName(counts.select(F.lit("summary").alias("part"), make(*counts.columns)))
    if found is None:
        return out
    proofs = proof_sources(theory, found).groupBy("literal").agg(F.sort_array(F.collect_set(F.struct("path", "line", "page"))).alias("p")).select("literal", F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["path"].alias("path"), x["line"].alias("line"))).alias("p"))
    told = found.join(proofs, "literal", "left")
    sources = F.when(F.col("tag").startswith("+"), F.col("p"))
    none = F.array().cast("array<struct<page:string,path:string,line:int>>")
    return out.unionByName(told.select(F.lit("conclusions").alias("part"), make("literal", F.col("tag").alias("conclusion_type"), F.coalesce(sources, none).alias("proof_sources"))))


def _written(c: Column) -> Column:
    return F.when(c.startswith("~"), F.concat(F.lit("(not "), F.substring(c, F.lit(2), F.length(c)), F.lit(")"))).otherwise(c)


def explain_failure(theory: Theory, found: DataFrame, literal: str, depth: int | None = None) -> DataFrame:
    """(depth, literal, tag, rule, role, kind, body, lacking, path, line): why a literal isn't provable.

    A row for each rule of role `for`, with those of its body's literals that don't hold, and of role `against`, whose
    head is the negation: rules of all kinds, so defeaters, too. What is lacking is explained in turn, as deep as it
    goes or down to `depth`; a literal without rules has one row. Of a literal's tags -d is given before -D: that it
    fails defeasibly says more than that nothing strict proves it.
    """
    good = found.filter(F.col("tag").isin("+D", "+d")).select("literal").distinct()
    tags = found.groupBy("literal").agg(F.max("tag").alias("_tag"))  # "-d" sorts after "-D"
    parts = theory.body.join(good.withColumn("ok", F.lit(True)), "literal", "left")
    bodies = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "literal", F.coalesce("ok", F.lit(False)).alias("ok")))).alias("b"))
    own = bodies.select("label", F.transform("b", lambda x: x["literal"]).alias("body"), F.transform(F.filter("b", lambda x: ~x["ok"]), lambda x: x["literal"]).alias("lacking"))
    told = theory.rules.join(own, "label", "left").select("label", "head", "kind", "body", "lacking", "path", "line")
    pro = told.filter("kind <> 'defeater'").select(F.col("head").alias("q"), F.lit("for").alias("role"), "*")
    con = told.select(negate(F.col("head")).alias("q"), F.lit("against").alias("role"), "*")
    sides = table(pro.unionByName(con).drop("head"), "sides")
    front = table(found.sparkSession.createDataFrame([(literal,)], "literal string").join(good, "literal", "left_anti"), "front")
    seen, out = front, None
    for d in count():
        rows = front.join(sides, F.col("literal") == F.col("q"), "left").join(tags, "literal", "left").select(F.lit(d).alias("depth"), "literal", F.coalesce("_tag", F.lit("none")).alias("tag"), F.col("label").alias("rule"), "role", "kind", "body", "lacking", "path", "line")
        rows = table(rows, "rows")
        out = rows if out is None else out.unionByName(rows)
        if d == depth:
            break
        front = table(rows.filter("role = 'for'").select(F.explode("lacking").alias("literal")).distinct().join(seen, "literal", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out


def suggestions(theory: Theory) -> DataFrame:
    """(literal, rule, action, other): what would settle each literal that is headed both ways.

    `prefer` sets a defeasible rule above one for the other side; `weaken` turns a defeasible rule with a defeasible
    opponent into a defeater; `remove` drops a defeater that stands against a defeasible rule.
    """
    name = F.when(F.col("head").startswith("~"), negate(F.col("head"))).otherwise(F.col("head"))
    own = theory.rules.filter("kind <> 'strict'").select("label", "kind", "head", name.alias("literal"))
    left, right = own.select("literal", F.col("label").alias("rule"), F.col("kind").alias("k"), F.col("head").alias("h")), own.select("literal", F.col("label").alias("other"), F.col("kind").alias("ok"), F.col("head").alias("oh"))
    pairs = left.join(right, "literal").filter("h <> oh and ok = 'defeasible'")
    prefer = pairs.filter("k = 'defeasible'").select("literal", "rule", F.lit("prefer").alias("action"), "other")
    alone = pairs.select("literal", "rule", F.when(F.col("k") == "defeater", "remove").otherwise("weaken").alias("action"), F.lit(None).cast("string").alias("other"))
    return prefer.unionByName(alone).distinct()
