import duckdb
import pandas as pd
import pytest

from recordloom.llm import mixing
from recordloom.llm.queries import op6_mixing
from tests.llm.fixtures import SCHEMA, odd_rows, plain_documents, with_clashes

COLUMNS = ["doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def sql_rows(frame):
    con = duckdb.connect()
    con.register("docs_frame", frame)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM docs_frame")
    names = ", ".join(COLUMNS)
    return sorted(con.execute(f"SELECT {names} FROM ({mixing.oracle_sql()})").fetchall(), key=str)


def test_small_table_against_sql(spark, small):
    expected = sql_rows(pd.read_parquet(f"{small}/documents.parquet"))
    assert rows_of(op6_mixing(spark, small)) == expected and expected


@pytest.mark.parametrize("size", [mixing.RANGE, 3])
def test_odd_rows_and_small_ranges(spark, small, monkeypatch, size):
    monkeypatch.setattr(mixing, "RANGE", size)
    rows = [r for r in plain_documents(small) + odd_rows() if r[0] is not None]
    frame = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])
    assert rows_of(mixing.mix(with_clashes(spark.createDataFrame(rows, SCHEMA)))) == sql_rows(frame)


def test_budget_is_met_and_shortages_go_to_siblings_first(spark):
    rows = [(i, "a b c d e f g h i j", lang, f"{lang}-{k % 2}", 19) for k, (i, lang) in enumerate((n, "en" if n % 3 else "de") for n in range(300))]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = mixing.token_counts(docs)
    leaves = mixing.budgets(counts).collect()
    assert sum(r.given for r in leaves) == 3000 * 6 // 10
    assert all(0 <= r.given <= 2 * r.held for r in leaves)
    taken = mixing.mix(docs).groupBy("domain", "lang", "source").sum("take_tokens").collect()
    assert {tuple(r)[:3]: r[3] for r in taken} == {(r.domain, r.lang, r.source): r.given for r in leaves if r.given}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_are_taken_like_others(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 5), (1, "d e", "en", "s", 3)], SCHEMA)
    assert sum(r.take_tokens for r in mixing.mix(docs).collect()) == 3
