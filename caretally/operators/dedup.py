"""One row per key. Spark keeps only the leading row of each key per map task
(WindowGroupLimit) before it shuffles, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caretally.operators.skew import HotKeys, OrderBy, hot_keys, number_rows, sort_columns


def keep_first(df: DataFrame, keys: str | Sequence[str], order_by: OrderBy) -> DataFrame:
    """The first row per key in the given order. Null keys count as equal."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*keys).orderBy(*sort_columns(order_by))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def keep_last(df: DataFrame, keys: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key; ``order_by`` is the ascending order."""
    return keep_first(df, keys, [F.desc(c) for c in order_by])


def keep_values_on_edges(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    *,
    on_first: Sequence[str] = (),
    on_last: Sequence[str] = (),
    group_rows: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Null some columns everywhere but on the first, others everywhere but on
    the last row of each key. No row is dropped. One ordering gives both edges
    where every key fits a task; ``hot`` as in ``number_rows``."""
    hot = hot_keys(df, keys, group_rows) if hot is None else hot
    if not hot:
        w = W.partitionBy(*keys).orderBy(*sort_columns(order_by))
        edges = {"_rn": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)}
        kept = {c: F.when(F.col("_rn") == 1, F.col(c)) for c in on_first}
        kept |= {c: F.when(F.col("_next").isNull(), F.col(c)) for c in on_last}
        return df.withColumns(edges).withColumns(kept).drop(*edges)
    size = {"group_rows": group_rows, "hot": hot}
    for columns, order in ((on_first, list(order_by)), (on_last, [F.desc(c) for c in order_by])):
        if columns:
            df = number_rows(df, keys, order, name="_rn", **size)
            df = df.withColumns({c: F.when(F.col("_rn") == 1, F.col(c)) for c in columns}).drop("_rn")
    return df


def claim_map(claims: DataFrame, mode: str = "pairs") -> DataFrame:
    """claim_no, encounter_id, patient_id from claims that repeat per procedure.

    ``rows`` keeps every repeat, ``pairs`` each combination once, ``encounter``
    one (the lowest) claim per encounter.
    """
    rows = claims.select("claim_no", "encounter_id", "patient_id")
    if mode == "rows":
        return rows
    if mode == "pairs":
        return rows.distinct()
    if mode == "encounter":
        return keep_first(rows, "encounter_id", ["claim_no", "patient_id"])
    raise ValueError(f"unknown mode: {mode}")
