"""The registered queries: names, columns, SQL, and the pipeline."""

import random

import oracle
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridpanel.llm import queries
from gridpanel.llm.common import table

COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_tokens": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


def test_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert names == [f"op{i}" for i in range(1, 11)] and entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert COLUMNS.get(name, {}).items() <= dict(df.dtypes).items()
    keys = {"page_id": "pages", "doc_id": "documents", "image_id": "embeddings"}
    if name not in ("op2_media", "op8_decontamination"):
        assert df.count() == table(spark, small, keys[df.columns[0]]).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, medium, name):
    assert oracle.compared(spark, oracle.connect(medium), queries.QUERIES[name], queries.ORACLE_SQL[name], medium) is None


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small)
        assert kept.columns == docs.columns, name
        ids, before = [r["doc_id"] for r in kept.select("doc_id").collect()], {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert len(set(ids)) == len(ids) and set(ids) <= before and len(ids) > 0.5 * len(before), name
    out = corpus_pipeline.run(spark, small)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 50
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name


def test_stages_in_a_row_over_odd_rows(spark, small):
    """Nulls in every column, repeated rows, empty and very long texts, clashing names, one stage after the other."""
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    long = words(60_000)
    rows = [(1, long, "en", "a"), (2, words(200), None, None), (None, words(200), "en", "b"), (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t", "en", None), (6, "one", "en", "b"), (7, "x" * 100_000, "en", "b"), (8, "same text here again " * 30, "en", "a"), (8, "same text here again " * 30, "en", "a"), (9, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string, __gp_id long")
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, small).collect(), stage(spark, docs.limit(0), small).schema)
        assert out.columns[: len(docs.columns)] == docs.columns and {(r["__key"], r["__gp_id"]) for r in out.collect()} <= {("k", 1)}, name
        if name != "mixing":
            assert {None, 1, 2, 6, 7} <= {r["doc_id"] for r in out.collect()}, name
            assert {r["text"] for r in out.collect() if r["doc_id"] == 1} == {long}, name
            docs = out
    assert out.count() > 0
