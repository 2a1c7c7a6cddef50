"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import brown, decontam, divergence, htmlwrap, langid, mixing, neardup, secrets, sharding, suffixdedup, topk, toxicity, treaps
from recordloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; nulls, empty and repeated texts as in ``langid.identify``. A null doc_id
    counts as an empty id, which is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``, learned from its labelled rows; odd texts as in ``toxicity.score``. A null doc_id
    has no label and is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "matches")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; a text without a span has zero counts, the digest of an empty text and an
    empty ``spans``. Odd texts as in ``secrets.scan``."""
    scanned = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("secret_base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("secret_spans")).alias("spans"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; odd rows as in ``neardup.near_duplicates``."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a row of ``documents`` and an item of ``benchmark``; odd rows as in ``decontam.contained_items``."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; ties and odd rows as in ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; odd rows as in ``suffixdedup.deduplicate``."""
    return removal_digests(suffixdedup.deduplicate(table(spark, sf_dir, "documents")))


def removal_digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of what ``suffixdedup.deduplicate`` keeps and removes."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``pages``; odd pages as in ``htmlwrap.main_text``."""
    return htmlwrap.main_text(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rows for each query of ``embeddings``; ties and odd vectors as in ``topk.top_k``. A row of a null vec_id
    is no query."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; odd rows as in ``brown.score``. A null doc_id counts as an empty id, which
    is held out."""
    docs = table(spark, sf_dir, "documents")
    model, words = brown.fit(brown.training_rows(docs))
    scored = brown.score(docs, model, words)
    return scored.select("doc_id", langid.held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten rows of ``documents`` for each item of ``benchmark``; ties and odd rows as in ``treaps.ranked``."""
    return treaps.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and terms of each source of ``documents``; ties and odd rows as in ``divergence.audit``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``; repeated and odd rows as in ``sharding.shards_of``."""
    return sharding.shards_of(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_secret_scan": op3_secret_scan,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_main_text": op8_main_text,
        "op9_top_k": op9_top_k,
        "op10_class_lm": op10_class_lm,
        "op11_ranked_search": op11_ranked_search,
        "op12_source_divergence": op12_source_divergence,
        "op13_sharding": op13_sharding,
    }


#: DuckDB SQL, where SQL can express the result.
def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secrets.oracle_sql(),
        "op5_decontamination": decontam.ORACLE_SQL,
        "op6_mixing": mixing.oracle_sql(),
        "op9_top_k": topk.ORACLE_SQL,
        "op11_ranked_search": treaps.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_sharding": sharding.oracle_sql(),
    }
