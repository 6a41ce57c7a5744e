"""Work that grows with a text's length only, secrets without limits of form, and samples that repeats can't fill."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, quality, secrets

LONG = {
    "capitals and a small letter": "A" * 2_000_000 + "a",
    "beginnings of tokens": "eyJa-" * 400_000,
    "beginnings of tokens with dots": "eyJa.eyJabcdefgh" * 120_000,
    "a long user": "a://" + "u" * 2_000_000,
    "many users": "://u:" * 400_000,
    "names": "password:" * 200_000,
    "names and blanks": "token" + " " * 2_000_000,
    "beginnings of keys": "-----BEGIN PRIVATE KEY-----" * 70_000,
}


@pytest.mark.parametrize("text", LONG.values(), ids=LONG)
def test_long_texts_take_linear_time(text):
    began = time.time()
    secrets.candidates(text)
    quality.judge(text)
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "text, secret, kind",
    [
        (f"HTTPS://{'u' * 90}:pw1234@h.org", "pw1234", "url_password"),
        (f"{'x' * 40}://u:pw1234@h.org", "pw1234", "url_password"),
        ("redis://:pw1234@h.org", "pw1234", "url_password"),
        (f"{'a' * 50}_password = abcd1234", "abcd1234", "assigned"),
        ("my_own_db_password: abcd1234", "abcd1234", "assigned"),
        (f"password{' ' * 60}={' ' * 60}abcd1234", "abcd1234", "assigned"),
        ("x-eyJabcdefgh1.abcdefgh2.abcdefgh3!", "eyJabcdefgh1.abcdefgh2.abcdefgh3", "web_token"),
        ("eyJa-eyJabcdefgh1.abcdefgh2.abcdefgh3!", "eyJabcdefgh1.abcdefgh2.abcdefgh3", None),
    ],
)
def test_candidates_without_limits_of_form(text, secret, kind):
    found = [(text[a:b], k) for a, b, k in secrets.candidates(text)]
    assert any(secret in t and kind in (k, None) for t, k in found), found


def test_shouted_words():
    prose = " ".join(f"word{i}" for i in range(60))
    for line, failed in (("ABC DEF GHI JKL MNO PQR STU VWX", True), ("ABc DEf GHi JKl MNo PQr STu VWx", False), ("A B C D E F G H", False), ("ÄÖ1 É-È AA, «BB» CC DD EE FF", True)):
        assert (quality.judge(f"{prose}\n{line}")[0]["n_failed_lines"] == 1) == failed


def test_repeated_labelled_rows_are_one(spark):
    """Many equal rows, with an id or without, count as one row and don't crowd out others."""
    each = [(i, f"the cat and the dog {i}", "en") for i in range(40)]
    few = spark.createDataFrame(each, "doc_id long, text string, lang string")
    same = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the cat and the dog 7").alias("text"), F.lit("en").alias("lang"))
    null = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text"), F.lit("en").alias("lang"))
    plain = langid.fit_text_model(few.unionByName(null.limit(1)))
    assert np.array_equal(langid.fit_text_model(few.unionByName(same).unionByName(null)).log, plain.log)
    assert np.array_equal(plain.log, langid.TextModel.fit([(r[2], r[1]) for r in each] + [("en", "no id")]).log)


def test_most_languages(spark):
    rows = [(i, "abc def", f"l{i % 9}") for i in range(90)] + [(100 + i, "ghi", "l3") for i in range(5)]
    model = langid.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langs=4)
    assert model.langs == ["l0", "l1", "l2", "l3"]
