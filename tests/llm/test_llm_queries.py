"""Every query with SQL against DuckDB, and the pipeline's stages against their definitions."""

import math
from collections import Counter

import duckdb
import pytest

from quillgraph.llm import queries

D = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, D)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in cursor.fetchall())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet").cache()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = pipeline.quality_stage(spark, docs, D).cache()
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {r.doc_id for r in queries.QUERIES["op3_quality_rules"](spark, D).collect() if r.kept} and kept < ids
    one = pipeline.dedup_stage(spark, clean, D).cache()
    texts = {r.doc_id: r.text for r in one.collect()}
    assert set(texts) <= kept and len(set(texts.values())) == len(texts)
    safe = pipeline.secrets_stage(spark, one, D)
    assert {r.doc_id for r in safe.collect()} == set(texts)
    mixed = pipeline.mixing_stage(spark, safe, D)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = pipeline.packing_stage(spark, mixed, D).collect()
    assert sorted({p.sequence_id for p in packed}) == list(range(1 + max(p.sequence_id for p in packed)))
    again = pipeline.run(spark, D).collect()  # in another order, so cut elsewhere
    assert sum(p.length for p in again) == sum(p.length for p in packed)
    assert pipeline.packing_stage(spark, pipeline.mixing_stage(spark, pipeline.secrets_stage(spark, pipeline.dedup_stage(spark, pipeline.quality_stage(spark, docs.limit(0), D), D), D), D), D).count() == 0


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls, empties, repeats and ties in each stage: what the docstrings state."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(40).cache()
    long = docs.filter("n_chars > 600").first()
    null = {c: None for c in docs.columns}
    odd = [null, null, {**null, "doc_id": 9001}, {**null, "doc_id": 9002, "text": ""}, {**null, "text": long.text}, {**null, "text": long.text}, {**long.asDict(), "doc_id": 9003}, {**long.asDict(), "doc_id": 9003}]
    some = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema))
    clean = pipeline.quality_stage(spark, some, D)
    assert clean.columns == docs.columns and not clean.filter("text is null or text = ''").count()
    one = pipeline.dedup_stage(spark, some, D).collect()
    left = Counter((r.doc_id, r.text) for r in one)
    assert max(left.values()) == 1 and left[None, None] == left[None, long.text] == 1 and (9001, None) in left and (9003, long.text) not in left
    safe = pipeline.secrets_stage(spark, some, D)
    assert safe.count() == some.count() and safe.filter("text is null").count() == some.filter("text is null").count()
    mixed = pipeline.mixing_stage(spark, some, D)
    assert mixed.columns == docs.columns and not mixed.filter("text is null or text = ''").count()
    assert pipeline.packing_stage(spark, some, D).filter("doc_id = 9001").select("doc_tokens").first()[0] == 1
