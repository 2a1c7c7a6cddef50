"""Rows that every operator on documents must take: nulls, empty and long texts, repeated rows, clashing columns."""

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_documents(folder: str) -> list[tuple]:
    return [tuple(r.values()) for r in pq.read_table(f"{folder}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()]


def odd_rows() -> list[tuple]:
    return [
        (None, "a text without an id, of some words", "en", "web", 35),
        (900001, None, "en", "web", None),
        (900002, "", None, None, 0),
        (900003, "   \n\t ", "en", None, 6),
        (900004, "word", None, "web", 4),
        (900005, "eine lange zeile " * 20_000, "de", "web", 340_000),
        (900006, "twice the same row, word for word and more", "en", "web", 42),
        (900006, "twice the same row, word for word and more", "en", "web", 42),
        (900007, "ünïcödé ☃ \U0001f600 tèxt — “quotes” \u0000 nul", "fr", "hub", 30),
    ]


def with_clashes(df):
    """The same rows with more columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "score", "gram", "band", "h1", "rep", "component", "tokens", "domain", "weight", "hub", "n", "epoch", "place", "row", "w"):
        df = df.withColumn(name, F.lit("x"))
    return df
