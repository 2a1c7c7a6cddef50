"""Checks of declared resources and operations: all problems of all declarations at once, as rows.

Each rule is a filter over its own table; references between tables are anti joins, repeats a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What declarations may say.
KEY = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"
DIMENSIONS = ("value_set", "org_tree", "principal", "amount")
PUSHDOWNS = ("local_column", "local_projection", "not_pushdownable")
CLASSES = ("ordinary", "restricted", "secret")
QUERY_USES = ("filter", "sort", "group", "aggregate")
RISKS = ("low", "high")
SIDE_EFFECTS = ("business_write", "external_command", "job_or_subscription", "file_capability", "security_change", "notification")
STRICT_PURPOSES = ("read", "special_read", "export")
PURPOSES = ("read", "special_read", "export", "action", "create", "manage")
PATHS = ("default", "strict_acceptance", "strict_barrier")


def _rows(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """``subject, problem`` for every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), name) for name, condition in rules.items()]))
    return rows.select(subject.alias("subject"), F.explode(broken).alias("problem"))


def _missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def problems(resources: DataFrame, dimensions: DataFrame, fields: DataFrame, operations: DataFrame) -> DataFrame:
    """``subject, problem``: everything wrong with declarations, once each.

    ``resources``: type, view_operation; ``dimensions``: type, name, kind, column, currency_column, pushdown, watermark;
    ``fields``: type, name, class, read_key, queryable (array); ``operations``: key, resource_type, purpose, minimum_path,
    risk_class, side_effects (array), strict_audit, impersonation, tightening_only. Nulls are empty.
    """
    kind, effects = F.col("kind"), F.coalesce(F.col("side_effects"), F.array().cast("array<string>"))
    place = F.concat_ws(".", "type", "name")
    action = F.when(F.col("key").startswith(F.concat(F.col("resource_type"), F.lit("."))), F.substring("key", F.length("resource_type") + 2, F.length("key")))
    dimension = (  # a dimension's first problem only
        F.when(~F.coalesce(kind.isin(*DIMENSIONS), F.lit(False)), "dimension_kind").when(_missing("column"), "no_column").when((kind == "amount") & _missing("currency_column"), "no_currency")
        .when(~_missing("pushdown") & ~F.col("pushdown").isin(*PUSHDOWNS), "pushdown").when((F.col("pushdown") == "local_projection") & _missing("watermark"), "no_watermark")
    )
    found = [
        _rows(resources, F.col("type"), {"not_a_key": ~F.coalesce(F.col("type").rlike(KEY), F.lit(False))}),
        _rows(dimensions.withColumn("_why", dimension), place, {name: F.col("_why") == name for name in ("dimension_kind", "no_column", "no_currency", "pushdown", "no_watermark")}),
        _rows(fields, place, {
            "field_class": ~F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)), "no_read_key": (F.col("class") == "restricted") & _missing("read_key"),
            "query_use": F.exists(F.coalesce(F.col("queryable"), F.array().cast("array<string>")), lambda q: ~q.isin(*QUERY_USES)),
        }),
        _rows(operations, F.col("key"), {
            "not_a_key": ~F.coalesce(F.col("key").rlike(KEY), F.lit(False)), "not_one_action": action.isNull() | (action == "") | action.contains("."), "risk_class": ~F.coalesce(F.col("risk_class").isin(*RISKS), F.lit(False)),
            "purpose": ~F.coalesce(F.col("purpose").isin(*PURPOSES), F.lit(False)), "minimum_path": ~_missing("minimum_path") & ~F.col("minimum_path").isin(*PATHS), "side_effect": F.exists(effects, lambda e: ~e.isin(*SIDE_EFFECTS)), "strict_audit": F.col("strict_audit") & ~F.col("purpose").isin(*STRICT_PURPOSES),
            "impersonation": F.col("impersonation") & (F.size(effects) > 0), "tightening": F.col("tightening_only") & ~((F.col("purpose") == "manage") & (effects == F.array(F.lit("security_change")))),
        }),
        operations.join(resources.select(F.col("type").alias("resource_type")), "resource_type", "left_anti").select(F.col("key").alias("subject"), F.lit("resource_not_declared").alias("problem")),
        operations.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("subject"), F.lit("declared_twice").alias("problem")),
        resources.join(operations.select(F.col("key").alias("view_operation"), F.col("resource_type").alias("type")), ["view_operation", "type"], "left_anti").select(F.col("type").alias("subject"), F.lit("view_operation").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
