"""Reasoning: the textbook cases, and what is asked of conclusions."""

import pytest

from quillgraph.logic import reason, rules
from quillgraph.logic.rules import Theory

BIRDS = """(given bird) (given penguin) ; facts
(normally r1 bird flies)
(normally r2 penguin (not flies))
(prefer r2 r1)
(always r3 penguin bird-like)"""
BONUS = '(given employee) (given on-probation) (normally r1 employee eligible-for-bonus) (except d1 on-probation (not eligible-for-bonus))'


def theory(spark, *texts):
    blocks = [(f"p{i}.md", f"p{i}", 0, 1, t) for i, t in enumerate(texts)]
    return Theory.of_blocks(spark.createDataFrame(blocks, "path string, page string, ord int, start_line int, content string"))


def tags(t):
    out = {}
    for r in reason.conclusions(t).collect():
        out.setdefault(r.literal, set()).add(r.tag)
    return out


def test_penguin(spark):
    got = tags(theory(spark, BIRDS))
    assert "+d" in got["~flies"] and "-d" in got["flies"] and "+D" in got["bird"] and "+D" in got["bird-like"]


def test_defeater(spark):
    got = tags(theory(spark, BONUS))
    assert got["eligible-for-bonus"] == {"-D", "-d"}


def test_conflict_blocks_both(spark):
    t = theory(spark, "(given a) (given b) (normally r1 a x) (normally r2 b (not x)) (normally r3 x y)")
    got = tags(t)
    assert "-d" in got["x"] and "-d" in got["~x"] and "-d" in got["y"]
    assert [tuple(r) for r in reason.conflicts(t).collect()] == [("x", "r1", "r2")]
    assert {(r.rule, r.blocker, r.what) for r in reason.why_not(t, reason.conclusions(t), "y").collect()} == {("r3", "failed_body", "x")}


def test_team_defeat_and_cycles(spark):
    got = tags(theory(spark, "(given a) (normally r1 a x) (normally r2 a x) (normally s1 a (not x)) (normally s2 a (not x)) (prefer r1 s1) (prefer r2 s2) (normally c1 p q) (normally c2 q p)"))
    assert "+d" in got["x"] and "+d" not in got["p"] if "p" in got else True


def test_a_bad_block_leaves_others(spark):
    t = theory(spark, "(given good)", "(given broken")
    assert "+D" in tags(t)["good"] and t.errors.count() == 1
    for bad in ("(", ")", "x", "(what a)", "(given)"):
        with pytest.raises(rules.RuleError):
            list(rules.statements(bad))


def test_statements():
    got = list(rules.statements('(claims me :at "now" (given (not (owner "a b"))))\n(normally (and a b) c)\n(prefer r3 r2 r1)', 10))
    assert got[0]["head"] == '~(owner "a b")' and got[1]["body"] == ["a", "b"] and got[1]["line"] == 11 and [g["body"] for g in got[2:]] == [["r3", "r2"], ["r2", "r1"]]


def test_questions(spark):
    t = theory(spark, "(given code-reviewed) (normally r1 (and code-reviewed tests-pass) ready) (normally r2 ci-green tests-pass) (normally r3 ready shipped)")
    found = reason.conclusions(t)
    assert {(r.rule, r.needed) for r in reason.require(t, found, "ready").collect()} == {("r1", "ci-green")}
    assert {(r.kind, r.what) for r in t.problems().collect()} == {("unsupported_literal", "ci-green")}
    more = theory(spark, "(given ci-green) (given code-reviewed) (normally r1 (and code-reviewed tests-pass) ready) (normally r2 ci-green tests-pass) (normally r3 ready shipped)")
    after = reason.conclusions(more)
    change = {r.literal: (r.was, r.now) for r in reason.what_if(found, after).collect()}
    assert change["shipped"] == ("-D", "+d") and change["ci-green"] == ("-D", "+D")
    tree = reason.explain(more, after, "shipped").orderBy("depth", "literal").collect()
    assert [(r.depth, r.literal, r.rule) for r in tree] == [(0, "shipped", "r3"), (1, "ready", "r1"), (2, "code-reviewed", None), (2, "tests-pass", "r2"), (3, "ci-green", None)]
    s = reason.summary(more, after).first()
    assert (s.facts, s.defeasible_rules, s.files) == (2, 3, 1)
    assert {r.literal for r in reason.status(after, positive=True, definite=False, pattern="*s").collect()} >= {"tests-pass"}
    assert "(given ci-green)" in [r.value for r in reason.export(more).collect()]
    again = theory(spark, "\n".join(r.value for r in reason.export(more).collect()))
    assert tags(again) == tags(more)


def test_edge_facts(spark):
    e = spark.createDataFrame([("A", "B", "supports", 3), ("A", "C", "ex:x", 4), ("A", "D", None, 5)], "source string, target string, predicate string, line int")
    p = spark.createDataFrame([("A", "z/A.md"), ("A", "a/A.md")], "page string, path string")
    assert [(r.literal, r.path, r.line) for r in rules.edge_facts(e, p).collect()] == [('(supports "A" "B")', "a/A.md", 3)]


def test_theory_cache(spark):
    a = spark.createDataFrame([("k", "h")], "key string, ast_hash string")
    b = spark.createDataFrame([("k", "i")], "key string, ast_hash string")
    assert rules.same_blocks(a, a) and not rules.same_blocks(a, b) and not rules.same_blocks(a, a.limit(0))
