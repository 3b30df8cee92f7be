"""Aggregations shared by the reports. All of them combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.functions.dates import LAG_BOUNDS, lag_bucket
from caretally.operators.lists import SET_VALUES, set_summary

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Exact amount: sums of it do not depend on the order of the rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def count_if(test: Column) -> Column:
    """Aggregate: rows for which the test is true; 0, not null, if there are none."""
    return F.count(F.when(test, 1))


def distinct_by(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Exact count of distinct values per group. Spark first makes (group, value)
    unique, so a big group is counted by many tasks."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(name))


def money_parts(
    lines: DataFrame, claims: DataFrame, dims: Sequence[str], amount: str = "payment"
) -> tuple[Column, DataFrame]:
    """The total of the lines' amounts, as an aggregate, and the frame to aggregate, by
    period and by the dimensions of the lines' claim; see ``money_by``."""
    per_claim = lines.groupBy("claim_no", "period").agg(F.sum(money(amount)).alias("_amount"))
    repeats = claims.groupBy("claim_no", *dims).agg(F.count("*").cast("decimal(12,0)").alias("_times"))
    total = F.sum(F.col("_amount") * F.coalesce(F.col("_times"), F.lit(1).cast("decimal(12,0)")))
    return F.coalesce(total.cast("double"), F.lit(0.0)), per_claim.join(repeats, "claim_no", "left")


def money_by(
    lines: DataFrame,
    claims: DataFrame,
    dims: Sequence[str],
    *,
    amount: str = "payment",
    name: str = "total_payment",
) -> DataFrame:
    """Sum of the lines' amounts by period and by the dimensions of their claim.

    Lines join their claim on claim_no; a line whose claim repeats counts once
    per repeat, and a line without claim goes to the null group. Both sides are
    reduced before they meet: the lines to one row per claim and period, the
    claims to one row per claim and dimension values with the number of repeats.
    So no claim, however often it occurs, is hot in the join.
    """
    total, joined = money_parts(lines, claims, dims, amount)
    return joined.groupBy("period", *dims).agg(total.alias(name))


def mean_days(days: Column | str) -> Column:
    """Aggregate: mean lag to two places."""
    return F.round(F.avg(days), 2)


def _lags(days: str) -> dict:
    """Rows, rows with a known lag, and the sum of the lags."""
    known = F.when(F.col(days).isNotNull(), 1).otherwise(0)
    return {"labs": (F.lit(1).cast("long"), F.sum), "_known": (known.cast("long"), F.sum), "_days": (F.col(days), F.sum)}


def _mean() -> Column:
    return F.round(F.col("_days") / F.nullif(F.col("_known"), F.lit(0)), 2).alias("avg_rev")


def _values(lists: dict[str, Column | str]) -> dict[str, Column]:
    return {n: F.col(c) if isinstance(c, str) else c for n, c in lists.items()}


def lag_summary(
    df: DataFrame,
    key: str,
    days: str,
    lists: dict[str, Column | str],
    by: dict[str, Column] | None = None,
    set_values: int = SET_VALUES,
) -> DataFrame:
    """Per key (and ``by``): mean lag, rows, and a distinct list per entry of ``lists``."""
    keys = [key, *(by or {})]
    found = set_summary(df.withColumns(by or {}), keys, _lags(days), _values(lists), set_values=set_values)
    return found.select(*keys, *lists, _mean(), "labs")


def bucket_pivot(
    df: DataFrame, key: str, days: str, lists: dict[str, Column | str] | None = None, set_values: int = SET_VALUES
) -> DataFrame:
    """``lag_summary`` plus a count per lag bucket and shares, in one pass.

    A key without rows in a bucket shows null there, and so does the null key in
    every bucket. ``share_b2`` is the second bucket's share; ``share_b1`` and
    ``share_le_5`` are those of the first and of the first two.
    """
    lists = _values(lists or {})
    buckets = {f"b{b}": F.sum(F.when(F.col("_by") == str(b), F.col("labs")).otherwise(0)) for b in range(1, len(LAG_BOUNDS) + 2)}
    found = set_summary(df, [key], _lags(days), lists, by=lag_bucket(days), parts=buckets, set_values=set_values)
    grouped = found.select(key, *lists, _mean(), "labs", *buckets)

    def share(*parts: str) -> Column:
        part = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
        return F.round(part.cast("double") / F.col("labs"), 2)

    filled = {n: F.when(F.col(key).isNotNull(), F.nullif(F.col(n), F.lit(0))) for n in buckets}
    return grouped.withColumns({"share_b1": share("b1"), "share_le_5": share("b1", "b2")}).withColumns(
        filled | {"share_b2": F.round(filled["b2"].cast("double") / F.col("labs"), 2)}
    )


def run_metrics(parts: Sequence[tuple[str, DataFrame, dict[str, Column]]]) -> DataFrame:
    """(stage, metric, value) rows; each stage is read once for all its metrics."""
    rows = [
        df.agg(*[c.cast("double").alias(n) for n, c in wanted.items()])
        .unpivot([], list(wanted), "metric", "value")
        .select(F.lit(stage).alias("stage"), "metric", "value")
        for stage, df, wanted in parts
    ]
    return reduce(DataFrame.unionByName, rows)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming the keys if one repeats. Costs an
    aggregation: use it before a join that must not multiply rows."""
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"rows repeat for key {list(keys)}")
    return df
