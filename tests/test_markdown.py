"""The parser on the cases that a vault's pages show."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.sources import markdown as md
from quillgraph.sources.vault import Vault, changed, generate, load_cache, read_folder, save_cache, scanned

PAGE = """---
title: "T"
tags: [a, "b c"]
n: 3
list:
  - x
  - y
deep:
  k: true
---
# Top

See [[Page A]], [[Page B|alias]], [[Page C#Heading]] and [[Page D^block]]; ![[embed]].

- supports::cites::[[Typed]]
  - because of this
  - and that
> ex:partOf::[[Quoted]]

`[[inline]]` <!-- [[hidden]] -->

```python
[[fenced]]
```

```spl
(given a)
```

## Sub ^not

| a | b |
|---|---|
| 1 | 2 |

> quote

A paragraph ^id1

    indented [[code]]

***
"""


def test_links():
    found = {x["target_page"]: x for x in md.links(PAGE)}
    assert set(found) == {"Page A", "Page B", "Page C", "Page D", "embed", "Typed", "Quoted"}
    assert found["Page B"]["alias"] == "alias" and found["Page C"]["heading"] == "Heading" and found["Page D"]["block_ref"] == "block" and found["embed"]["is_embed"]
    assert found["Typed"]["predicates"] == ["supports", "cites"] and found["Typed"]["annotation"] == "because of this and that"
    assert found["Quoted"]["predicates"] == ["ex:partOf"] and found["Page A"]["predicates"] == []
    assert PAGE.split("\n")[found["Page A"]["line"] - 1][found["Page A"]["column"] - 1 :].startswith("[[Page A")


def test_blocks():
    kinds = [x["type"] for x in md.leaves(PAGE)]
    assert kinds == ["frontmatter", "heading", "paragraph", "list", "quote", "paragraph", "code", "rules", "heading", "table", "quote", "paragraph", "code", "rule_line"]
    leaves = md.leaves(PAGE)
    assert [x["block_id"] for x in leaves if x["block_id"]] == ["not", "id1"] and leaves[6]["language"] == "python" and leaves[1]["level"] == 1
    assert [(b["content"], PAGE.split("\n")[b["start_line"] - 1]) for b in md.rule_blocks(PAGE)] == [("(given a)", "```spl")]
    assert md.rule_blocks("<!--\n```spl\n(given x)\n```\n-->\n") == []


def test_frontmatter():
    assert md.frontmatter(PAGE) == {"title": "T", "tags": ["a", "b c"], "n": 3, "list": ["x", "y"], "deep": {"k": True}}
    assert md.frontmatter("no") == {} and md.frontmatter("---\n: [broken\n---\n") == {}


def test_diagnostics():
    text = "[[ok]] [[]]\n`[[` fine\n[[open\n[[a [[b]] c]]\n```\n[[in fence\n```\n"
    assert [(d["line"], d["message"].split()[0]) for d in md.diagnostics(text)] == [(1, "Empty"), (3, "Unclosed"), (4, "Nested")]


def test_headings_and_chunks():
    assert [(h["level"], h["text"]) for h in md.headings(PAGE)] == [(1, "Top"), (2, "Sub ^not")]
    long = "intro\n## One\n" + "x " * 900 + "\n## Two\n" + "y " * 900
    assert [c["heading"] for c in md.chunks(long)] == [None, "One", "Two"] and "".join(c["text"] for c in md.chunks(long)) == long
    assert len(md.chunks("short\n## One\n")) == 1


def test_texts():
    assert md.description("# T\n\nSome *bold* [[X|label]] and [a](b) `c`.\nMore.\n\nNext") == "Some bold label and a c. More."
    assert md.description("x " * 200).endswith("…") and len(md.description("x " * 200)) <= 161
    assert md.excerpt("<p>One two. " + "w " * 60 + "end.</p>", 50) == "One two."


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab[]|#^`-> \n!<:~*(\\1.", max_size=120))
def test_parser_is_total(text):
    masked = md.mask(text)
    assert len(masked) == len(text)
    for a, b in md.body_ranges(text):
        assert 0 <= a < b <= len(text)
    for x in md.links(text, masked):
        assert text.split("\n")[x["line"] - 1][x["column"] - 1 :].startswith(("[[", "![["))
    md.leaves(text), md.headings(text), md.diagnostics(text), md.rule_blocks(text), md.chunks(text), md.description(text), md.frontmatter(text)


def test_vault(spark, tmp_path):
    for name, text in (("Index.md", PAGE), ("notes/Page A.md", "[[Index]]"), ("drafts/x.md", "[[Index]]"), (".git/y.md", "z"), ("rules.spl", "(given b)"), ("pic.png", "no")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    v = Vault(read_folder(spark, str(tmp_path), exclude=("drafts/",)))
    assert sorted(r.path for r in v.pages.collect()) == ["Index.md", "notes/Page A.md", "rules.spl"]
    assert {(r.source, r.target) for r in v.edges.filter("not is_ghost").collect()} == {("Index", "Page A"), ("Page A", "Index")}
    assert {r.tag for r in v.tags.collect()} == {"a", "b c"}
    assert json.loads(v.pages.filter("page = 'Index'").first().frontmatter)["n"] == 3
    assert {r.content for r in v.spl_blocks.collect()} == {"(given a)", "(given b)"}
    save_cache(v.parsed, str(tmp_path / "cache"))
    assert load_cache(spark, str(tmp_path / "cache")).count() == 3
    assert Vault(v.source.limit(0)).edges.count() == 0


def test_cache_states(spark):
    cached = spark.createDataFrame([("a.md", 1, "h"), ("b.md", 1, None), ("c.md", 1, "h"), ("d.md", 1, "h"), ("e.spl", 1, None)], "path string, mtime int, root_hash string")
    now = spark.createDataFrame([("a.md", 1, "h"), ("b.md", 1, "h"), ("c.md", 2, "h"), ("d.md", 2, "x"), ("e.spl", 1, "q"), ("f.md", 1, "h")], "path string, mtime int, root_hash string")
    assert {r.path: r.state for r in changed(now, cached).collect()} == {"a.md": "hit", "b.md": "reparse", "c.md": "unchanged", "d.md": "reparse", "e.spl": "hit", "f.md": "new"}


def test_scan_rules(spark):
    paths = ["a.md", "node_modules/a.md", "x/.git/a.md", ".hid/a.md", ".ok/a.md", "sub/a.md", "assets/a.md", "a.txt", "b.fountain"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in scanned(df, whitelist=(".ok",), nested=("sub",)).collect()} == {"a.md", ".ok/a.md", "b.fountain"}


def test_generated_vault(spark):
    v = Vault(generate(spark, 60, 5))
    e = v.edges
    assert e.count() == 300 and 0.1 < e.filter("is_ghost").count() / 300 < 0.35


def test_descriptions_at_the_limit():
    fits = "a" * 79 + " " + "b" * 80
    assert len(fits) == 160 and md.fitted(fits) == fits and md.fitted(f"  {fits}\n") == fits
    # 160 characters that end with a word, and more: the word goes, as the blank inside the limit is the last
    assert md.fitted(fits + " c") == "a" * 79 + "…"
    assert md.fitted("a" * 155 + ", " + "b" * 20) == "a" * 155 + "…" and md.fitted("a" * 158 + "--" + "b" * 9) == "a" * 158 + "…"
    assert md.fitted("a" * 159 + " b c") == "a" * 159 + "…"


def test_excerpts():
    body = lambda n: " ".join(["word"] * n)
    assert md.excerpt("<p>One &amp; two.</p>\n<p>Three\nfour.</p>", 50) == "One & two.\n\nThree four."
    assert md.excerpt(f"<p>{body(48)}.</p><div>A b. C d e. F.</div>", 50) == body(48) + ".\n\nA b."
    assert md.excerpt(f"<p>{body(50)}</p><p>More.</p>", 50) == body(50)
    assert md.excerpt(f"<p>{body(60)}.</p><p>More.</p>", 50) == "" and md.excerpt("", 50) == "" == md.excerpt("<p></p> ", 99)
    assert md.excerpt("a<br>b <video x>no<p>no</VIDEO >c<img src=x>d<script>never ends <p>x", 50) == "a\n\nb cd"
    assert md.excerpt("a <b", 50) == "a" and md.excerpt("1 &lt; 2 &amp;lt; 3 é<i>ü</i>", 50) == "1 < 2 < 3 éü"
    assert md.excerpt(f"<p>Pi is 3.14. Then {body(60)}.</p>", 50) == "Pi is 3. 14."
    assert len(md.excerpt("x. " * 900, 900).split()) == 500 and md.excerpt("<p" * 200_000, 50) == "" and md.excerpt("<style>" * 100_000, 50) == ""
