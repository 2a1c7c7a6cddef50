"""Declared tables: reading with a schema that is checked, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType


class SchemaMismatch(ValueError):
    """Columns that are missing, extra or of another type than declared."""


#: Spark's type of each archive type; UUIDs and JSON are texts.
TYPES: dict[str, DataType] = {
    "smallint": ShortType(), "int": IntegerType(), "bigint": LongType(), "numeric": DecimalType(38, 18), "boolean": BooleanType(), "timestamp": TimestampNTZType(),
    "date": DateType(), "binary": BinaryType(), "text": StringType(), "uuid": StringType(), "json": StringType(), "text[]": ArrayType(StringType()),
}


def declared(kinds: dict[str, str]) -> StructType:
    """The schema of columns of archive types."""
    if unknown := sorted(set(kinds.values()) - set(TYPES)):
        raise ValueError(f"no archive types {unknown}")
    return StructType([StructField(name, TYPES[kind]) for name, kind in kinds.items()])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def assert_schema(df: DataFrame, declared: StructType) -> DataFrame:
    """``df`` if its columns are the declared ones in order and type, nullable or not; Spark alone would read a
    missing column as nulls."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    wanted = [(f.name, f.dataType.simpleString()) for f in declared.fields]
    if actual != wanted:
        missing = [c for c in wanted if c not in actual]
        extra = [c for c in actual if c not in wanted]
        raise SchemaMismatch(f"missing {missing}, not declared {extra}" if missing or extra else f"order {actual}")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share, named in spark.checkpoint.dir; a temporary one only where Spark runs
    on one machine and names none, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or tempfile.mkdtemp(prefix="recordloom-")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read again from the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
