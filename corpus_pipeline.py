"""The corpus pipeline: five operators of recordloom.llm, each on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontam, langid, mixing, neardup, secrets
from recordloom.llm.common import of_ids, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language can't be told at all: no letter, or no language above this probability.
LEAST_LANGUAGE_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model of their own labelled rows tells.

    A null text, or one without a letter, tells none and goes; every other text has some language, and goes only if none
    reaches LEAST_LANGUAGE_SCORE. Repeated rows stay or go together. An empty table stays empty. A null lang or source
    plays no part; columns beside those of documents are left out.
    """
    found = langid.identify(docs, langid.fit(langid.training_rows(docs)), kept=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class.

    Rows of one id are one document, so all of them stay if it does; a null id is an id like others here. A null text is a
    class of its own. An empty table stays empty.
    """
    kept = written(neardup.near_duplicates(docs).where("keep").select("doc_id").distinct())
    return of_ids(docs, kept, "left_semi").select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A null or empty text holds none and stays, as does a row without an id. Rows of one id go together. An empty table stays
    empty; without items every document stays.
    """
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark.

    No row goes. A null text stays null; repeated rows get equal texts; an empty table stays empty.
    """
    return secrets.redact(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, epochs and token prefixes of the mix.

    A text without a token, null or not, is never taken; ties of the seeded order and repeated rows as in ``mixing.mix``. An
    empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: Language scores, sampled signatures and entropy windows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
