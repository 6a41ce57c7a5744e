"""Conclusions by parts, by rounds and after changes against the proof theory tag by tag."""

import random
import time

import pytest

from quillgraph.logic import parts, reason
from quillgraph.logic.rules import Theory


def no(q):
    return q[1:] if q[0] == "~" else "~" + q


def by_definition(facts, rules, better):
    """All tags, by trying every condition for every literal until nothing changes."""
    own = {x for _, head, body in rules.values() for x in (head, *body)} | set(facts)
    lits = own | set(map(no, own))
    tags = set()
    has = lambda q, t: (q, t) in tags
    while True:
        new = set()
        for q in lits:
            pro = [(r, k, b) for r, (k, h, b) in rules.items() if h == q]
            con = [(r, b) for r, (k, h, b) in rules.items() if h == no(q)]
            above = lambda s: [(t, b) for t, k, b in pro if k != "defeater" and (t, s) in better]
            ok, out = (lambda b: all(has(x, "+d") for x in b)), (lambda b: any(has(x, "-d") for x in b))
            if q in facts or any(k == "strict" and all(has(x, "+D") for x in b) for _, k, b in pro):
                new.add((q, "+D"))
            if q not in facts and all(k != "strict" or any(has(x, "-D") for x in b) for _, k, b in pro):
                new.add((q, "-D"))
            if has(q, "+D") or (any(k != "defeater" and ok(b) for _, k, b in pro) and has(no(q), "-D") and all(out(b) or any(ok(c) for _, c in above(s)) for s, b in con)):
                new.add((q, "+d"))
            if has(q, "-D") and (all(k == "defeater" or out(b) for _, k, b in pro) or has(no(q), "+D") or any(ok(b) and all(out(c) for _, c in above(s)) for s, b in con)):
                new.add((q, "-d"))
        if new <= tags:
            return tags
        tags |= new


def drawn(rng, atoms, n):
    lit = lambda: rng.choice(["", "~"]) + rng.choice(atoms)
    rules = {f"{atoms[0]}r{i}": (rng.choice(["strict", "defeasible", "defeasible", "defeater"]), lit(), frozenset(lit() for _ in range(rng.randrange(0, 3)))) for i in range(n)}
    names = list(rules)
    better = {(rng.choice(names), rng.choice(names)) for _ in range(n)}
    return {lit() for _ in range(2)}, rules, better


def text_of(facts, rules, better):
    said = lambda q: f"(not {q[1:]})" if q[0] == "~" else q
    word = {"strict": "always", "defeasible": "normally", "defeater": "except"}
    out = [f"(given {said(f)})" for f in sorted(facts)]
    for r, (k, h, b) in rules.items():
        body = sorted(map(said, b))
        out.append(f"({word[k]} {r} {body[0] if len(body) == 1 else '(and ' + ' '.join(body) + ')'} {said(h)})")
    return "\n".join([*out, *(f"(prefer {t} {s})" for t, s in sorted(better))])


def theory(spark, texts):
    return Theory.of_blocks(spark.createDataFrame([(f"p{i}.spl", f"p{i}", 0, 1, t) for i, t in enumerate(texts)], "path string, page string, ord int, start_line int, content string"))


def test_solving_by_counters():
    rng = random.Random(7)
    for _ in range(400):
        one = drawn(rng, list("abcdef"[: rng.randrange(1, 7)]), rng.randrange(1, 14))
        assert set(parts.solve(*one)) == by_definition(*one), one


def test_a_long_chain_takes_linear_time():
    rules = {f"r{i}": ("defeasible", f"x{i + 1}", frozenset([f"x{i}"])) for i in range(200_000)}
    began = time.time()
    found = set(parts.solve({"x0"}, rules, set()))
    assert ("x200000", "+d") in found and ("~x5", "-d") in found and time.time() - began < 30
    # one literal with very many rules for and against it
    hot = {f"p{i}": ("defeasible", "q", frozenset([f"y{i}"])) for i in range(50_000)} | {f"n{i}": ("defeasible", "~q", frozenset([f"z{i}"])) for i in range(50_000)}
    assert ("q", "+d") in set(parts.solve({"y7"}, hot, set())) and time.time() - began < 60


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    pages = [drawn(rng, [f"{chr(97 + i)}{k}" for k in range(5)], 9) for i in range(12)]
    pages = [(f, {r: x for r, x in rules.items() if x[2]}, b) for f, rules, b in pages]
    return pages, set().union(*(by_definition(f, r, {(t, s) for t, s in b if t in r and s in r}) for f, r, b in pages))


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_parts_and_rounds(spark, many):
    pages, want = many
    t = theory(spark, [text_of(*p) for p in pages])
    assert found(parts.conclusions(t)) == want
    assert found(parts.conclusions(t, most=12)) == want  # some parts by rounds
    rows = parts.statements(t)
    assert rows.select("part").distinct().count() >= 12
    got, work = parts.by_rounds(rows)
    assert found(got) == want and work[-1][1] == 0 and work[-1][0] < work[0][0]


def test_rounds_follow_the_change(spark):
    """A chain: each round looks at a few literals, whatever the theory's size."""
    n = 12
    t = theory(spark, ["(given x0)\n" + "\n".join(f"(normally r{i} x{i} x{i + 1})" for i in range(n)), "\n".join(f"(normally s{i} y{i} z{i})" for i in range(300))])
    got, work = parts.by_rounds(parts.statements(t))
    assert (f"x{n}", "+d") in found(got) and max(looked for looked, _ in work[4:]) <= 8 < work[0][0]


def test_a_changed_theory(spark, many):
    pages, _ = many
    rng = random.Random(9)
    before = theory(spark, [text_of(*p) for p in pages])
    old = reason.conclusions(before)
    changed = list(pages)
    facts, rules, better = changed[0]
    changed[0] = (facts | {"a1"}, rules, better)
    facts, rules, better = changed[1]
    changed[1] = (facts, {r: x for r, x in list(rules.items())[1:]}, set())
    changed[2] = drawn(rng, ["new1", "new2"], 3)
    changed[2] = (changed[2][0], {r: x for r, x in changed[2][1].items() if x[2]}, changed[2][2])
    after = theory(spark, [text_of(*p) for p in changed])
    assert found(parts.revised(before, old, after)) == found(parts.conclusions(after))
    assert found(parts.revised(before, old, before)) == found(old)
