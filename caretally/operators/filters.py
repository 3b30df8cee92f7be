"""Row filters that are more than one comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_in(df: DataFrame, column: str, labels: Sequence) -> DataFrame:
    """Rows whose label is listed, the labels read as the column's type. Null labels drop out.

    Lists are settings of a report and go into the plan whatever their length, so
    the scan can use them.
    """
    return df.where(_listed(df, column, labels))


def label_not_in(df: DataFrame, column: str, labels: Sequence) -> DataFrame:
    """Rows whose label is not listed. Null labels drop out as well, and nulls in the list say nothing."""
    return df.where(F.col(column).isNotNull() & ~_listed(df, column, labels))


def _listed(df: DataFrame, column: str, labels: Sequence) -> Column:
    kind = df.schema[column].dataType
    return F.col(column).isin([F.lit(v).cast(kind) for v in labels if v is not None])


def split_by(df: DataFrame, test: Column, name: str) -> DataFrame:
    """Both halves of a split at once, told apart by a boolean column. Rows for
    which the test is null are in neither half and keep a null flag."""
    return df.withColumn(name, test)


def both(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def not_both(*tests: Column) -> Column:
    """The complement of ``both``. A null that decides drops the row from each."""
    return ~both(*tests)


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
