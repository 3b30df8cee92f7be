"""Lab turnaround: answered or not, in house or not, and time to review."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.functions.dates import (
    NO_RESULT,
    NO_REVIEW,
    elapsed_days,
    happened,
    in_month,
    lag,
    lag_bucket,
    lag_text,
    parse_stamp,
)
from caretally.functions.text import is_zero
from caretally.operators.aggs import bucket_pivot, count_if, lag_summary, mean_days
from caretally.operators.filters import both, not_both
from caretally.operators.lists import distinct_values

# Report list -> column it is made of.
STAFF_LISTS = {"assigned_to": "assigned_to_id", "ordered_by": "orderer_id", "orderer_names": "orderer_name"}


def typed_labs(raw: DataFrame) -> DataFrame:
    """The columns of the all-text extract that the reports need, with types."""
    return raw.select(
        F.col("EncounterId").try_cast("long").alias("encounter_id"),
        F.col("ItemId").try_cast("long").alias("item_id"),
        F.col("ReviewedBy").alias("reviewed_by"),
        F.col("assignedToId").alias("assigned_to_id"),
        F.col("ordPhyId").alias("orderer_id"),
        F.col("ordPhyName").alias("orderer_name"),
        parse_stamp("collDate").alias("coll_date"),
        parse_stamp("ResultDate").alias("result_date"),
        parse_stamp("ReviewedDate").alias("reviewed_date"),
    )


def month_of_results(labs: DataFrame, year: int, month: int, column: str = "result_date") -> DataFrame:
    return labs.where(in_month(column, year, month))


def with_lags(labs: DataFrame, in_house_ids: Sequence[int], run_time: datetime | None = None) -> DataFrame:
    """Adds the lags and what the splits need.

    ``answered_compat`` asks only whether collection-to-result can be computed;
    ``answered`` asks for a real result date. ``reviewed`` is false for the
    sentinel year and, like the marker it stands for, true for an unknown date.
    """
    rows = labs.withColumns(
        {
            "result_lag": lag("coll_date", "result_date"),
            "review_lag": lag("result_date", "reviewed_date"),
            "result_days": F.when(happened("result_date"), elapsed_days("coll_date", "result_date")),
            "review_days": F.when(happened("reviewed_date"), elapsed_days("result_date", "reviewed_date")),
            "in_house": F.col("item_id").isin(list(in_house_ids)),
            "reviewed": F.coalesce(happened("reviewed_date"), F.lit(True)),
            "answered": F.coalesce(happened("result_date"), F.lit(False)),
        }
    ).withColumn("answered_compat", F.col("result_lag").isNotNull() | ~F.coalesce(happened("result_date"), F.lit(True)))
    return rows if run_time is None else rows.withColumn("run_time", F.lit(run_time).cast("timestamp_ntz"))


def report_rows(labs: DataFrame) -> DataFrame:
    """The labs with both lags as text, and the markers where nothing happened."""
    never = ~happened("result_date"), ~happened("reviewed_date")
    return labs.withColumns(
        {
            "result_lag": F.when(never[0], F.lit(NO_RESULT)).otherwise(lag_text(F.col("result_lag"))),
            "review_lag": F.when(never[1], F.lit(NO_REVIEW)).otherwise(lag_text(F.col("review_lag"))),
        }
    )


def outcome_counts(labs: DataFrame, answered: str = "answered_compat") -> DataFrame:
    """Labs and encounters in each of the four cells answered x in house."""
    return labs.groupBy(answered, "in_house").agg(
        F.count("*").alias("labs"), F.countDistinct("encounter_id").alias("encounters")
    )


def _same_day() -> tuple[Column, Column]:
    return F.col("result_days") == 0, F.col("reviewed")


# --- splits ------------------------------------------------------------------

# The flags that tell the splits apart. Labs are staged once, in folders by these, and each
# split reads its own folders.
SPLIT_COLUMNS = ("answered_compat", "answered", "in_house", "same_day")

# Split -> test of the flags. An unknown item is neither in house nor not.
SPLITS = {
    "with_result": "answered_compat",
    "with_result_in_house": "answered_compat AND in_house",
    "with_result_sent_out": "answered_compat AND NOT in_house",
    "waiting": "NOT answered_compat",
    "waiting_in_house": "NOT answered_compat AND in_house",
    "waiting_sent_out": "NOT answered_compat AND NOT in_house",
    "answered": "answered",
    "not_in_house": "NOT in_house",
    "same_day_reviewed": "same_day",
    "not_same_day": "NOT same_day",
}


def with_same_day(labs: DataFrame) -> DataFrame:
    """Adds ``same_day``: resulted on the day of the collection, and reviewed. An unknown
    result lag is not the same day."""
    same, reviewed = _same_day()
    return labs.withColumn("same_day", F.coalesce(same, F.lit(False)) & reviewed)


def split(labs: DataFrame, name: str) -> DataFrame:
    """One of ``SPLITS``, of labs with the flags."""
    return labs.where(SPLITS[name])


def split_counts(labs: DataFrame) -> DataFrame:
    """Labs and distinct encounters of every split, in one pass, zeros included.

    Encounters are serial numbers, so each cell of flags holds them as bitmaps of 32,768
    numbers. Bitmaps of cells unite exactly, so splits that overlap share the work.
    """
    cells = labs.groupBy(*SPLIT_COLUMNS, F.bitmap_bucket_number("encounter_id").alias("_bucket")).agg(
        F.count("*").alias("_labs"), F.bitmap_construct_agg(F.bitmap_bit_position("encounter_id")).alias("_bits")
    )
    inside = {n: F.expr(test) for n, test in SPLITS.items()}
    united = cells.groupBy("_bucket").agg(
        *[F.sum(F.when(test, F.col("_labs"))).alias(f"_labs_{n}") for n, test in inside.items()],
        *[F.bitmap_or_agg(F.when(test, F.col("_bits"))).alias(f"_bits_{n}") for n, test in inside.items()],
    )
    totals = united.agg(
        *[F.coalesce(F.sum(f"_labs_{n}"), F.lit(0)).alias(f"labs_{n}") for n in inside],
        *[F.coalesce(F.sum(F.bitmap_count(f"_bits_{n}")), F.lit(0)).alias(f"encounters_{n}") for n in inside],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("split"), F.col(f"labs_{n}").alias("labs"), F.col(f"encounters_{n}").alias("encounters")) for n in inside])
    return totals.select(F.inline(rows))


def same_day_reviewed(labs: DataFrame) -> DataFrame:
    return labs.where(both(*_same_day()))


def not_same_day_reviewed(labs: DataFrame) -> DataFrame:
    """The complement; an unknown result lag counts as not the same day."""
    same, reviewed = _same_day()
    return labs.where(not_both(F.coalesce(same, F.lit(False)), reviewed))


def lag_histogram(labs: DataFrame, days: str = "review_days") -> DataFrame:
    return labs.groupBy(days).agg(F.count("*").alias("labs"))


def _staff_lists(suffix: str) -> dict[str, Column]:
    text = {n: F.col(c).cast("string") for n, c in STAFF_LISTS.items()}
    marked = ("ordered_by", "orderer_names")
    return {n: F.concat(c, F.lit(suffix)) if suffix and n in marked else c for n, c in text.items()}


def reviewer_summary(labs: DataFrame, suffix: str = "//", **size) -> DataFrame:
    """Per reviewer: assignees, orderers (each marked by the suffix), mean lag, labs."""
    return lag_summary(labs, "reviewed_by", "review_days", _staff_lists(suffix), **size)


def reviewer_staff(labs: DataFrame, suffix: str = "//") -> DataFrame:
    """Every entry of the lists of ``reviewer_summary``, however long they are."""
    return distinct_values(labs, ["reviewed_by"], _staff_lists(suffix))


def reviewer_buckets(labs: DataFrame, suffix: str = "//", **size) -> DataFrame:
    """``reviewer_summary`` with the five lag buckets and the late share."""
    return bucket_pivot(labs, "reviewed_by", "review_days", _staff_lists(suffix), **size)


def bucket_detail(labs: DataFrame, **size) -> DataFrame:
    """Mean lag, labs and distinct lists per reviewer and bucket, all buckets at once."""
    known = labs.where(F.col("review_days").isNotNull())
    return lag_summary(known, "reviewed_by", "review_days", _staff_lists(""), {"bucket": lag_bucket("review_days")}, **size)


def answered_unreviewed(labs: DataFrame) -> DataFrame:
    """Answered labs whose reviewer is 0, as number or text."""
    return labs.where(is_zero("reviewed_by"))


def pending_queue(labs: DataFrame) -> DataFrame:
    """Per assignee: orderers, mean lag, labs."""
    return lag_summary(labs, "assigned_to_id", "review_days", {"ordered_by": F.col("orderer_id").cast("string")})


def encounter_summary(labs: DataFrame) -> DataFrame:
    """Per encounter: labs, mean lag, labs waiting for review."""
    return labs.groupBy("encounter_id").agg(
        F.count("*").alias("labs"), mean_days("review_days").alias("avg_rev"), count_if(~F.col("reviewed")).alias("pending")
    )


def encounter_counts(labs: DataFrame) -> DataFrame:
    return labs.groupBy("encounter_id").agg(F.count("*").alias("labs"))


def in_report_order(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy(F.desc("share_b2"), F.asc("avg_rev"))
