"""Conclusions part by part: statements that share no atom, directly or through others, can't affect each other.

Parts are the connected components of atoms that rules link. A part of few statements is solved in one pass with
counters: of each rule how much of its body is still open, of each literal how many rules for and against it are. A tag
is looked at again only where a counter of it moved, so the work is that of the part's size. Parts are streamed, one at
a time, through the tasks that hold them. Larger parts go on in rounds over tables, each of which takes the literals
that the last one's tags can change. A changed theory is solved again only in the parts that the change touches.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.iterate import components
from ..scratch import table
from .rules import Theory

#: Statements of a part that one task solves at once.
PART_ROWS = 200_000
TAGS = ("+D", "-D", "+d", "-d")
NAMES = ("def_yes", "def_no", "yes", "no")


def negate(c: Column) -> Column:
    return F.when(c.startswith("~"), F.substring(c, F.lit(2), F.length(c))).otherwise(F.concat(F.lit("~"), c))


def atom(c: Column) -> Column:
    """A literal's name without its sign, as a number: equal ones by chance only put two parts together."""
    return F.xxhash64(F.when(c.startswith("~"), F.substring(c, F.lit(2), F.length(c))).otherwise(c))


def solve(facts: set[str], rules: dict[str, tuple[str, str, frozenset[str]]], better: set[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(literal, tag) of a theory in memory: rules by label as (kind, head, body), better as (superior, inferior)."""
    no = lambda q: q[1:] if q[0] == "~" else "~" + q
    own = {x for kind, head, body in rules.values() for x in (head, *body)} | facts
    literals = own | set(map(no, own))
    uses = defaultdict(list)
    hold_left, sure_left, failed, barred, beaten = {}, {}, set(), set(), set()
    strict_open, open_, foes = (defaultdict(int) for _ in range(3))
    some_ok, strict_ok, foe_wins = set(), set(), set()
    for r, (kind, head, body) in rules.items():
        hold_left[r] = sure_left[r] = len(body)
        for x in body:
            uses[x].append(r)
        strict_open[head] += kind == "strict"
        open_[head] += kind != "defeater"
        foes[no(head)] += 1
    weaker, above = defaultdict(list), defaultdict(int)
    for t, s in better:
        if t in rules and s in rules and rules[t][0] != "defeater" and rules[s][1] == no(rules[t][1]):
            weaker[t].append(s)
            above[s] += 1
    tags: dict[str, set[str]] = {q: set() for q in literals}
    todo: deque[tuple[str, str]] = deque()

    def give(q: str, tag: str) -> None:
        if tag not in tags[q]:
            tags[q].add(tag)
            todo.append((q, tag))

    def look(q: str) -> None:
        mine, other = tags[q], tags[no(q)]
        if q in facts or q in strict_ok:
            give(q, "+D")
        elif q not in facts and not strict_open[q]:
            give(q, "-D")
        if "+D" in mine or (q in some_ok and "-D" in other and not foes[q]):
            give(q, "+d")
        if "-D" in mine and (not open_[q] or "+D" in other or q in foe_wins):
            give(q, "-d")

    def holds(r: str) -> None:
        kind, head, _ = rules[r]
        if kind != "defeater":
            some_ok.add(head)
            for s in weaker[r]:
                if s not in beaten:
                    beaten.add(s)
                    foes[head] -= s not in failed
        if not above[r]:
            foe_wins.add(no(head))

    def fails(r: str) -> None:
        kind, head, _ = rules[r]
        if kind != "defeater":
            open_[head] -= 1
            for s in weaker[r]:
                above[s] -= 1
                if not above[s] and not hold_left[s]:
                    foe_wins.add(head)
        foes[no(head)] -= r not in beaten

    for r, (kind, head, body) in rules.items():
        if not body:
            holds(r)
            if kind == "strict":
                strict_ok.add(head)
    for q in literals:
        look(q)
    while todo:
        q, tag = todo.popleft()
        for r in uses[q]:
            kind, head, _ = rules[r]
            if tag == "+D":
                sure_left[r] -= 1
                if not sure_left[r] and kind == "strict":
                    strict_ok.add(head)
            elif tag == "-D" and r not in barred:
                barred.add(r)
                strict_open[head] -= kind == "strict"
            elif tag == "+d":
                hold_left[r] -= 1
                if not hold_left[r]:
                    holds(r)
            elif tag == "-d" and r not in failed:
                failed.add(r)
                fails(r)
            look(head)
            look(no(head))
        look(q)
        look(no(q))
    for q, found in tags.items():
        for tag in found:
            yield q, tag


def _solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their parts: one part is held at a time."""
    now, facts, rules, better = None, set(), {}, set()

    def done() -> Iterator[pa.RecordBatch]:
        found = list(solve(facts, rules, better))
        for at in range(0, len(found), 50_000):
            some = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.string()) for i in (0, 1)], names=["literal", "tag"])

    for batch in batches:
        for part, label, kind, head, body in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield from done()
                now, facts, rules, better = part, set(), {}, set()
            if kind == "fact":
                facts.add(head)
            elif kind == "prefer":
                better.add((label, head))
            else:
                rules[label] = (kind, head, frozenset(body))
    if now is not None:
        yield from done()


def statements(theory: Theory) -> DataFrame:
    """(part, label, kind, head, body): facts and rules, and preferences as (superior, inferior) in label and head, each with its part."""
    bodies = theory.body.groupBy("label").agg(F.collect_set("literal").alias("body"))
    none = F.array().cast("array<string>")
    rules = table(theory.rules.select("label", "kind", "head").join(bodies, "label", "left").select("label", "kind", "head", F.coalesce("body", none).alias("body")), "rules")
    facts = theory.facts.select(F.lit(None).cast("string").alias("label"), F.lit("fact").alias("kind"), F.col("literal").alias("head"), none.alias("body")).distinct()
    roots = table(components(rules.select(atom(F.col("head")).alias("a"), F.explode("body").alias("x")).select("a", atom(F.col("x")).alias("b")), local=PART_ROWS), "parts")
    own = table(rules.unionByName(facts).withColumn("at", atom(F.col("head"))).join(roots.withColumnRenamed("node", "at"), "at", "left").select(F.coalesce("root", "at").alias("part"), "label", "kind", "head", "body"), "statements")
    heads = own.filter("kind <> 'fact'").select("part", "label", "head", "kind")
    t, s = heads.select(F.col("label").alias("superior"), F.col("head").alias("th"), "part"), heads.select(F.col("label").alias("inferior"), F.col("head").alias("sh"))
    better = theory.superiority.join(t, "superior").join(s, "inferior").filter(F.col("sh") == negate(F.col("th")))
    return own.unionByName(better.select("part", F.col("superior").alias("label"), F.lit("prefer").alias("kind"), F.col("inferior").alias("head"), none.alias("body")))


def conclusions(theory: Theory, most: int = PART_ROWS) -> DataFrame:
    """(literal, tag) of every literal that is tagged; parts of more than `most` statements are solved in rounds."""
    return _of_statements(table(statements(theory), "in-parts"), most)


def _of_statements(rows: DataFrame, most: int) -> DataFrame:
    sizes = table(rows.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("part"), "large")
    large = rows.join(sizes, "part", "left_semi")
    few = rows.join(sizes, "part", "left_anti").repartition("part").sortWithinPartitions("part")
    found = few.select("part", "label", "kind", "head", "body").mapInArrow(_solve_parts, "literal string, tag string")
    return found if sizes.isEmpty() else found.unionByName(by_rounds(large)[0])


def by_rounds(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(literal, tag) of statements() by rounds over tables, and of each round how many literals it looked at and changed.

    A round looks at the heads of rules with a literal in the body that the last round tagged, at what the last round
    tagged, and at the negations of both.
    """
    rules = table(rows.filter("kind not in ('fact', 'prefer')").select("label", "kind", "head", atom(F.col("head")).alias("at"), "body"), "rules")
    body = table(rules.select("label", "at", F.explode("body").alias("literal")), "body")
    facts = table(rows.filter("kind = 'fact'").select(F.col("head").alias("literal")).distinct(), "facts")
    sup = table(rows.filter("kind = 'prefer'").select(F.col("label").alias("superior"), F.col("head").alias("inferior")).distinct(), "superiority")
    own = rules.select(F.col("head").alias("literal")).unionByName(body.select("literal")).unionByName(facts.select("literal"))
    every = own.unionByName(own.select(negate(F.col("literal")).alias("literal"))).distinct()
    state = table(every.select("literal", atom(F.col("literal")).alias("at"), *(F.lit(False).alias(n) for n in NAMES)), "state")
    looked, work = None, []
    while True:
        mine, r, b = (x if looked is None else x.join(looked, "at", "left_semi") for x in (state, rules, body))
        seen = Observation()
        now = _round(mine, r.drop("body"), b, facts, sup, state)
        changed = F.col("sum") != F.col("before")
        now = table(now.withColumn("before", sum((F.col(f"_{n}").cast("int") for n in NAMES), F.lit(0))).withColumn("sum", sum((F.col(n).cast("int") for n in NAMES), F.lit(0))).withColumn("new", changed).drop("before", "sum", *(f"_{n}" for n in NAMES)), "looked-at", seen, F.count(F.lit(1)).alias("n"), F.count_if("new").alias("new"))
        work.append((seen.get["n"], seen.get["new"]))
        if not seen.get["new"]:
            break
        state = table(state.join(now.select("literal"), "literal", "left_anti").unionByName(now.drop("new")), "state")
        moved = now.filter("new").select("literal", "at")
        looked = table(body.join(moved.select("literal"), "literal", "left_semi").select("at").unionByName(moved.select("at")).distinct(), "next")
    tags = F.filter(F.array(*(F.when(F.col(n), F.lit(t)) for n, t in zip(NAMES, TAGS, strict=True))), lambda t: t.isNotNull())
    return state.select("literal", F.explode(tags).alias("tag")), work


def _round(mine: DataFrame, rules: DataFrame, body: DataFrame, facts: DataFrame, sup: DataFrame, state: DataFrame) -> DataFrame:
    """mine(literal, at, NAMES) after a round, with what it was before as `_` columns; rules and body are those for it and against it."""
    s = state.drop("at")
    used = body.select("label", "literal").join(s, "literal").groupBy("label").agg(F.bool_and("def_yes").alias("all_sure"), F.bool_or("def_no").alias("some_barred"), F.bool_and("yes").alias("all_hold"), F.bool_or("no").alias("some_fail"))
    r = rules.join(used, "label", "left").na.fill(True, ["all_sure", "all_hold"]).na.fill(False, ["some_barred", "some_fail"])
    # attackers of a literal, each with whether some stronger rule for the literal beats it, and whether all such are discarded
    support = r.filter("kind <> 'defeater'").select("head", F.col("label").alias("t"), F.col("all_hold").alias("t_ok"), F.col("some_fail").alias("t_out"))
    attack = r.select(negate(F.col("head")).alias("q"), F.col("label").alias("s"), F.col("all_hold").alias("s_ok"), F.col("some_fail").alias("s_out"))
    beats = attack.select("q", "s").join(sup, F.col("s") == F.col("inferior")).join(support, (F.col("t") == F.col("superior")) & (F.col("head") == F.col("q"))).groupBy("q", "s").agg(F.bool_or("t_ok").alias("beaten"), F.bool_and("t_out").alias("none_left"))
    foes = attack.join(beats, ["q", "s"], "left").na.fill(False, ["beaten"]).na.fill(True, ["none_left"])
    foe = foes.groupBy("q").agg(F.bool_and(F.col("s_out") | F.col("beaten")).alias("foes_out"), F.bool_or(F.col("s_ok") & F.col("none_left")).alias("foe_wins"))
    own = r.groupBy(F.col("head").alias("q")).agg(
        F.bool_or((F.col("kind") == "strict") & F.col("all_sure")).alias("strict_ok"), F.bool_and((F.col("kind") != "strict") | F.col("some_barred")).alias("strict_out"),
        F.bool_or((F.col("kind") != "defeater") & F.col("all_hold")).alias("some_ok"), F.bool_and((F.col("kind") == "defeater") | F.col("some_fail")).alias("all_out"),
    )
    other = mine.select(negate(F.col("literal")).alias("literal"), F.col("def_yes").alias("other_sure"), F.col("def_no").alias("other_barred"))
    all_ = (
        mine.join(facts.withColumn("given", F.lit(True)), "literal", "left").join(own.withColumnRenamed("q", "literal"), "literal", "left").join(foe.withColumnRenamed("q", "literal"), "literal", "left").join(other, "literal", "left")
        .na.fill(False, ["given", "strict_ok", "some_ok", "foe_wins", "other_sure", "other_barred"]).na.fill(True, ["strict_out", "all_out", "foes_out"])
    )
    sure = F.col("def_yes") | F.col("given") | F.col("strict_ok")
    barred = F.col("def_no") | (~F.col("given") & F.col("strict_out"))
    holds = F.col("yes") | F.col("def_yes") | (F.col("some_ok") & F.col("other_barred") & F.col("foes_out"))
    fails = F.col("no") | (F.col("def_no") & (F.col("all_out") | F.col("other_sure") | F.col("foe_wins")))
    return all_.select("literal", "at", *(c.alias(n) for c, n in zip((sure, barred, holds, fails), NAMES, strict=True)), *(F.col(n).alias(f"_{n}") for n in NAMES))


def revised(before: Theory, found: DataFrame, after: Theory, most: int = PART_ROWS) -> DataFrame:
    """The conclusions of `after` from those of `before`: parts that no changed statement touches keep theirs.

    A statement that goes or comes can change what its own part of the new theory concludes; all other literals of the
    new theory have the tags that they had.
    """
    now = table(statements(after), "in-parts")
    flat = lambda rows: rows.select(F.concat_ws("\x01", "kind", "label", "head", F.array_join(F.array_sort("body"), "\x02")).alias("key"), "kind", "label", "head", "body")
    old, new = flat(table(statements(before), "before")), flat(now)
    moved = table(old.join(new.select("key"), "key", "left_anti").unionByName(new.join(old.select("key"), "key", "left_anti")), "moved")
    # a preference touches the head of its superior rule, in either theory
    heads = old.unionByName(new).filter("kind not in ('fact', 'prefer')").select("label", "head").distinct()
    by_rule = moved.filter("kind = 'prefer'").select("label").join(heads, "label").select(atom(F.col("head")).alias("at"))
    touched = by_rule.unionByName(moved.filter("kind <> 'prefer'").select(atom(F.col("head")).alias("at"))).distinct()
    atoms = now.filter("kind <> 'prefer'").select("part", F.explode(F.concat(F.array("head"), "body")).alias("x")).select("part", "x", atom(F.col("x")).alias("at")).distinct()
    parts = table(atoms.join(touched, "at", "left_semi").select("part").distinct(), "touched")
    stays = atoms.join(parts, "part", "left_anti").select("x")
    kept = found.join(stays.unionByName(stays.select(negate(F.col("x")).alias("x"))).distinct().withColumnRenamed("x", "literal"), "literal", "left_semi")
    return kept.select("literal", "tag").unionByName(_of_statements(now.join(parts, "part", "left_semi"), most))
