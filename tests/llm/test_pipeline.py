import re

import duckdb
import pyarrow.parquet as pq

import corpus_pipeline
from recordloom.llm import secrets
from recordloom.llm.common import table
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes
from tests.llm.test_decontam import brute as contained
from tests.llm.test_mixing import sql_rows
from tests.llm.test_neardup import brute as classes

COLUMNS = corpus_pipeline.COLUMNS


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_every_stage_against_brute_force(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = with_clashes(spark.createDataFrame(plain_documents(small) + odd_rows(), SCHEMA))
    kept = stages["language_id"](spark, docs, small)
    assert kept.columns == COLUMNS
    rows = rows_of(kept)
    assert {r[0] for r in plain_documents(small)} - {r[0] for r in rows} == {r[0] for r in plain_documents(small) if not re.search(r"[^\W\d_]", r[1] or "")}
    assert not {900001, 900002, 900003} & {r[0] for r in rows}

    one = stages["near_duplicates"](spark, kept, small)
    class_of = dict(classes([r[:2] for r in rows], spark))
    rows_one = rows_of(one)
    assert {r[0] for r in rows_one} == set(class_of.values())
    assert len({class_of[r[0]] for r in rows_one}) == len({r[0] for r in rows_one})

    clean = stages["decontamination"](spark, one, small)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    dirty = {e[0] for e in contained([r[:2] for r in rows_one], items)}
    rows_clean = rows_of(clean)
    assert rows_clean == [r for r in rows_one if r[0] not in dirty] and dirty

    safe = stages["secret_scan"](spark, clean, small)
    rows_safe = rows_of(safe)
    assert [r[0] for r in rows_safe] == [r[0] for r in rows_clean]
    assert secrets.scan(safe).where("size(secret_base) > 0").count() == 0

    mixed = stages["mixing"](spark, safe, small)
    frame = safe.select("doc_id", "text", "lang", "source").toPandas()
    assert sorted((tuple(r[c] for c in ["doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens"]) for r in mixed.collect()), key=str) == sql_rows(frame)


def test_run_applies_the_stages_in_turn(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "mixing"]
    ids = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{small}/documents.parquet'").fetchall()}
    assert {r.doc_id for r in found.select("doc_id").collect()} <= ids


def test_empty_documents(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name
