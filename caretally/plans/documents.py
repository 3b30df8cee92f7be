"""Document review: how long reviewers take, and what lies unreviewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.functions.dates import calendar_days, in_month, parse_day_first, parse_stamp, within
from caretally.functions.text import split_two
from caretally.operators.aggs import count_if
from caretally.operators.dedup import keep_first
from caretally.operators.filters import label_in
from caretally.operators.skew import OrderBy


def typed_documents(raw: DataFrame) -> DataFrame:
    """The columns of the all-text extract that the report needs, with types."""
    return raw.select(
        F.col("docID").try_cast("long").alias("doc_id"),
        F.col("PatientId").try_cast("long").alias("patient_id"),
        F.col("ReviewerId").try_cast("long").alias("reviewer_id"),
        F.col("reviewername").alias("reviewer_name"),
        F.col("ScannedBy").alias("scanned_by"),
        F.col("customName").alias("custom_name"),
        F.col("fileformat").alias("file_format"),
        F.col("filename").alias("file_name"),
        F.col("Review").try_cast("int").alias("review"),
        F.col("delFlag").try_cast("int").alias("del_flag"),
        parse_stamp("scanDate").alias("scan_date"),
    )


def typed_report(raw: DataFrame) -> DataFrame:
    """The external report; ``id:name`` becomes two columns."""
    patient, name = split_two("Patient Acct No + Name", ":")
    return raw.select(
        F.col("Document ID").try_cast("long").alias("doc_id"),
        parse_day_first("Reviewed Date").alias("reviewed_date"),
        F.col("Scanned By").alias("report_scanned_by"),
        F.col("Reviewer Name").alias("report_reviewer_name"),
        patient.alias("report_patient_id"),
        name.alias("report_patient_name"),
    )


def month_of_documents(documents: DataFrame, year: int, month: int) -> DataFrame:
    return documents.where(in_month("scan_date", year, month))


def assigned_documents(documents: DataFrame, reviewer_ids: Sequence[int], tie_break: OrderBy) -> DataFrame:
    """Live documents of the given reviewers, one row per document."""
    rows = label_in(documents, "reviewer_id", reviewer_ids).where(F.col("del_flag") == 0)
    return keep_first(rows, "doc_id", tie_break)


def review_lags(assigned: DataFrame, report: DataFrame, tie_break: OrderBy, limit: int = 5) -> DataFrame:
    """Documents with their report row, the days from scan to review and a flag
    for at most ``limit`` days.

    A document listed several times counts once. Its first report row is taken
    before the join, so that the join adds no rows.
    """
    listed = keep_first(report.where(F.col("doc_id").isNotNull()), "doc_id", tie_break)
    joined = assigned.join(listed, "doc_id", "left")
    days = calendar_days("scan_date", "reviewed_date")
    return joined.withColumn("review_days", days).withColumn("in_time", within("review_days", limit))


def reviewer_sla(lags: DataFrame, key: str = "reviewer_id", label: str = "reviewer_name") -> DataFrame:
    """Per reviewer: documents, reviewed, unreviewed, in time, and two rates.

    ``pct_compat`` is whole hundreds: the integer quotient of in-time by
    reviewed, times 100. It passes 100 if unreviewed documents carry a date.
    ``pct`` is the real percentage, over reviewed documents alone.
    """
    reviewed = F.col("review") == 1
    counts = {
        "documents": F.count("*"),
        "reviewed": count_if(reviewed),
        "unreviewed": count_if(F.col("review") == 0),
        "in_time": count_if(F.col("in_time") == 1),
        "_in_time_reviewed": count_if(reviewed & (F.col("in_time") == 1)),
    }
    # By name first: counts alone are hashed, while the greatest name of the few
    # rows left would have sorted all documents.
    named = lags.groupBy(key, label).agg(*[c.alias(n) for n, c in counts.items()])
    grouped = named.groupBy(key).agg(F.max(label).alias(label), *[F.sum(n).alias(n) for n in counts])
    return grouped.withColumns(
        {
            "pct_compat": F.expr("(in_time div nullif(reviewed, 0)) * 100"),
            "pct": F.col("_in_time_reviewed") * 100.0 / F.nullif(F.col("reviewed"), F.lit(0)),
        }
    ).drop("_in_time_reviewed")


def unreviewed(assigned: DataFrame) -> DataFrame:
    return assigned.where((F.col("review") == 0) & (F.col("del_flag") == 0))


def in_report_order(sla: DataFrame) -> DataFrame:
    return sla.orderBy(F.desc("unreviewed"))
