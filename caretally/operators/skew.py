"""Joins and numbering that hold when one key owns a large part of the rows.

Where the session lets AQE split skewed joins in every plan, joins are left to it, but
for the one it cannot split: a left join with a hot right side. Otherwise sizes are
looked up first: a row count, and for frames too big for one task a count per key
hash, combined on the map side and kept in a table. Data without hot keys takes
Spark's plain join or window; only data with a key too big for one task takes the
longer way. All ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretally.session import stage, stage_bucketed

# Rows of one key that a single task may handle, unless the session sets
# spark.caretally.hotRows or the caller says otherwise.
HOT_ROWS = 1_000_000
# Most pieces of one numbering, which its range partitioning samples 100 rows each
# of; beyond it pieces grow, and their sorts spill.
MAX_PIECES = 20_000

OrderBy = Sequence[str | Column]


def sort_columns(order_by: OrderBy) -> list[Column]:
    """Names become ascending columns. An empty order is refused: the result of
    an ordered operator must not depend on how the rows are stored."""
    if not order_by:
        raise ValueError("an ordered operator needs order_by, with a unique tie-break")
    return [F.col(c).asc() if isinstance(c, str) else c for c in order_by]


def _limit(df: DataFrame, rows: int | None) -> int:
    return int(df.sparkSession.conf.get("spark.caretally.hotRows", str(HOT_ROWS))) if rows is None else rows


# --- dimension join ----------------------------------------------------------


def lookup_join(left: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a dimension.

    Nothing is forced to broadcast. Spark broadcasts a dimension whose size, from
    file statistics or measured at run time, is below
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one is sort-merge joined
    and AQE splits the fact's hot keys.
    """
    return left.join(dimension, on, "left")


def stage_by(df: DataFrame, label: str, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """A staged frame that is joined and grouped by the same keys several times: written
    once more in buckets of these keys, unless one of them is too big for one task. Such
    frames stay as they are, and each step spreads the key its own way."""
    keys = list(keys)
    return df if hot_keys(df, keys, hot_rows) else stage_bucketed(df, label, keys)


# --- salted join -------------------------------------------------------------


@dataclass(frozen=True)
class HotKeys:
    """``keys``: a staged table (_h, _pieces) of the hashes of the keys above the
    limit and the pieces to cut each in, or None if there are none. ``rows``: the
    number of rows looked at."""

    keys: DataFrame | None = None
    rows: int = 0

    def __bool__(self) -> bool:
        return self.keys is not None

    def pieces_of(self, df: DataFrame, on: Sequence[str]) -> DataFrame:
        """The frame with ``_pieces``, 1 for keys that are not hot. The table is not
        forced to broadcast: a long one is sort-merged, and AQE splits the frame."""
        named = df.withColumn("_h", F.xxhash64(*on)).join(self.keys, "_h", "left").drop("_h")
        return named.withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))


def row_counts(*frames: DataFrame) -> list[int]:
    """Rows of each frame, counted in one job."""
    tagged = [df.select(F.lit(i).alias("frame")) for i, df in enumerate(frames)]
    found = {r["frame"]: r["count"] for r in reduce(DataFrame.union, tagged).groupBy("frame").count().collect()}
    return [found.get(i, 0) for i in range(len(frames))]


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int | None = None, rows: int | None = None) -> HotKeys:
    """Keys with more than ``hot_rows`` rows; ``rows`` is the frame's size, if known.

    A frame of no more rows than that has none. Otherwise rows are counted per key
    hash; at most rows / hot_rows of these are kept, and none comes to the driver. A
    collision of hashes only salts a key that did not need it.
    """
    hot_rows = _limit(df, hot_rows)
    n = df.count() if rows is None else rows
    if n <= hot_rows:
        return HotKeys(rows=n)
    counts = df.select(F.xxhash64(*on).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    pieces = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_pieces")
    found = stage(counts.where(F.col("_n") > hot_rows).select("_h", pieces), "hot_keys")
    return HotKeys(None if found.isEmpty() else found, n)


def aqe_splits(spark: SparkSession) -> bool:
    """Whether AQE splits every skewed join it can. Without the force setting it gives
    a split up where the next step is grouped by the same key."""
    wanted = ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin")
    return all(spark.conf.get(f"spark.sql.adaptive.{c}") == "true" for c in wanted)


def _salted(df: DataFrame, hot: HotKeys, on: Sequence[str], name: str) -> DataFrame:
    # The salt comes from the row's place in a staged table, read in the same order
    # by a task that is run again; rows that are equal throughout are spread as well.
    placed = hot.pieces_of(df.withColumn("_at", F.monotonically_increasing_id()), on)
    salt = F.pmod(F.xxhash64("_at"), F.col("_pieces")).cast("int")
    return placed.withColumn(name, salt).drop("_at", "_pieces")


def _copied(df: DataFrame, hot: HotKeys, on: Sequence[str], name: str) -> DataFrame:
    """Each row once per piece of its own key."""
    every = F.sequence(F.lit(0), F.col("_pieces") - 1)
    return hot.pieces_of(df, on).withColumn(name, F.explode(every)).drop("_pieces")


def _split(left: DataFrame, right: DataFrame, on: list[str], how: str, hot_l: HotKeys, hot_r: HotKeys) -> DataFrame:
    keys = list(on)
    if hot_l:
        left = _salted(left, hot_l, on, "_ls")
    if hot_r:
        right = _salted(right, hot_r, on, "_rs")
    if hot_l:
        right = _copied(right, hot_l, on, "_ls")
        keys.append("_ls")
    if hot_r:
        left = _copied(left, hot_r, on, "_rs")
        keys.append("_rs")
    return left.join(right, keys, how).drop("_ls", "_rs")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    *,
    unique_right: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join of two big frames on columns of the same name and type.

    Rows of a hot key are spread over as many tasks as it needs; the other side's
    rows of that key are copied to each. A side with hot keys is staged first.
    ``how``: inner, left, left_semi or left_anti. ``unique_right`` says the right
    side has one row per key, so that only the left side can be hot. What AQE splits
    (see ``aqe_splits``) is a plain join without a look at the sizes, unless
    ``hot_rows`` is given.
    """
    on = [on] if isinstance(on, str) else list(on)
    for key in on:
        if left.schema[key].dataType != right.schema[key].dataType:
            raise ValueError(f"cast {key} to one type on both sides first")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")

    # A null key never matches.
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    right = right.where(known)
    if how == "inner":
        left = left.where(known)
    if hot_rows is None and aqe_splits(left.sparkSession):
        if how != "left" or unique_right or not hot_keys(right, on):
            return left.join(right, on, how)
        left, right = stage(left, "split"), stage(right, "split")
        lonely = left.join(right.select(*on).distinct(), on, "left_anti")
        return left.join(right, on, "inner").unionByName(lonely, allowMissingColumns=True)
    if how in ("left_semi", "left_anti"):
        right, unique_right = right.select(*on).distinct(), True

    sizes = row_counts(left) if unique_right else row_counts(left, right)
    hot_l = hot_keys(left, on, hot_rows, sizes[0])
    hot_r = HotKeys() if unique_right else hot_keys(right, on, hot_rows, sizes[1])
    if not hot_l and not hot_r:
        return left.join(right, on, how)
    if hot_l:
        left = stage(left, "salted")
    if hot_r:
        right = stage(right, "salted")
    if how == "left" and hot_r:
        matched = _split(left, right, on, "inner", hot_l, hot_r)
        lonely = _split(left, right.select(*on).distinct(), on, "left_anti", hot_l, HotKeys())
        return matched.unionByName(lonely, allowMissingColumns=True)
    return _split(left, right, on, how, hot_l, hot_r)


# --- numbering ---------------------------------------------------------------


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: OrderBy,
    *,
    name: str = "rn",
    running: dict[str, Column] | None = None,
    group_rows: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Row number per key in the given order, and running sums next to it.

    If every key fits one task this is a window per key. Otherwise the rows are
    range-partitioned on key *and* order, which cuts a big key into consecutive
    pieces; each piece is numbered alone and then shifted by the size of the
    pieces before it. ``order_by`` must end in a unique tie-break. ``hot`` hands
    over what ``hot_keys`` found for the same rows and keys.
    """
    keys, order, running = list(keys), sort_columns(order_by), running or {}
    up_to_here = (W.unboundedPreceding, W.currentRow)

    hot = hot_keys(df, keys, group_rows) if hot is None else hot
    if not hot:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns(
            {name: F.row_number().over(w).cast("long")}
            | {c: F.sum(v).over(w.rowsBetween(*up_to_here)) for c, v in running.items()}
        )

    pieces = min(MAX_PIECES, max(2, ceil(hot.rows / _limit(df, group_rows))))
    measures = {f"_m{i}": v for i, v in enumerate(running.values())}
    cut = stage(
        df.withColumns(measures)
        .repartitionByRange(pieces, *[F.col(k).asc() for k in keys], *order)
        .withColumn("_piece", F.spark_partition_id()),
        "numbered",
    )
    w = W.partitionBy("_piece", *keys).orderBy(*order)
    local = cut.withColumns(
        {name: F.row_number().over(w).cast("long")}
        | {c: F.sum(m).over(w.rowsBetween(*up_to_here)) for c, m in zip(running, measures)}
    )
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    owner = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    shift = (
        cut.groupBy("_piece", *keys)
        .agg(F.count("*").alias("_n"), *[F.sum(m).alias(m) for m in measures])
        .withColumns({"_n": F.sum("_n").over(before)} | {m: F.sum(m).over(before) for m in measures})
        .where(F.col("_n").isNotNull())
        .select("_piece", "_n", *[v.alias(k) for k, v in owner.items()], *[F.col(m).alias(f"{m}_b") for m in measures])
    )
    # Pieces are consecutive, so at most one key per piece began in an earlier
    # one: ``shift`` has one row per piece at most, MAX_PIECES in all.
    joined = local.join(F.broadcast(shift), "_piece", "left")
    mine = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, owner)])
    shifted = mine & F.col("_n").isNotNull()
    whole = {name: F.col(name) + F.when(shifted, F.col("_n")).otherwise(F.lit(0))}
    for c, m in zip(running, measures):
        prior = F.when(shifted, F.col(f"{m}_b"))
        whole[c] = F.when(F.col(c).isNull(), prior).when(prior.isNull(), F.col(c)).otherwise(F.col(c) + prior)
    return joined.withColumns(whole).select(*df.columns, name, *running)
