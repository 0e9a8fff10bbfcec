"""Readers. Connection options always come from the caller."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import CSV_NULL_TOKENS, null_tokens


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def typed_columns(schema: T.StructType) -> list[Column]:
    return [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to a declared schema; what cannot be cast becomes null."""
    return df.select(*typed_columns(schema))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = lower_names(spark.read.parquet(path))
    return df if columns is None else df.select(*columns)


def read_warehouse(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    schema: T.StructType | None = None,
    split_on: tuple[str, str, str, int] | None = None,
) -> DataFrame:
    """A warehouse table or parenthesised query over JDBC.

    `split_on = (column, low, high, parts)` reads it with many connections at once.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if split_on is not None:
        column, low, high, parts = split_on
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(parts))
    df = lower_names(reader.load())
    return df if schema is None else typed(df, schema)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    sep: str = ",",
    null_strings: Iterable[str] = CSV_NULL_TOKENS,
    drop: Iterable[str] = (),
    encoding: str = "UTF-8",
    row: str | None = None,
) -> DataFrame:
    """Delimited text with a header, read as text, null strings removed, then cast to `schema`.

    The header decides which column is which; blank lines are skipped. `row` names a column to sort by for the order of
    the rows in the file, and of the files by name.
    """
    as_text = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False)
    if row is not None:
        as_text = as_text.withColumn(row, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    clean = null_tokens(lower_names(as_text), list(null_strings))
    return clean.select(*typed_columns(schema), *([row] if row else [])).drop(*drop)


def read_text_columns(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Delimited text with a header and defaults, every column as text."""
    return lower_names(spark.read.csv(path, sep=sep, header=True, inferSchema=False))
