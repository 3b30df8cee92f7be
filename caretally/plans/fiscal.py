"""Claim counts, revenue and collections by provider, fiscal period and dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.functions.text import like_any_case
from caretally.operators.aggs import distinct_by, money_by, money_parts
from caretally.operators.dedup import keep_first
from caretally.operators.filters import label_in
from caretally.operators.skew import OrderBy, lookup_join, salted_join
from caretally.session import stage

PROVIDER = "resource_provider_name"


def with_period(df: DataFrame, date_column: str, calendar: DataFrame) -> DataFrame:
    """Adds the fiscal period of a date; null where the calendar has no such day.

    Revenue and collections differ only in the date given here: service date for
    revenue, deposit date for collections.
    """
    days = calendar.select(F.to_date("dates").alias("_day"), "period")
    return lookup_join(df.withColumn("_day", F.to_date(date_column)), days, "_day").drop("_day")


def checked_out(visits: DataFrame, label: str = "Check Out") -> DataFrame:
    return visits.where(like_any_case("visit_status", f"%{label}%"))


def in_periods(df: DataFrame, periods: Sequence[str]) -> DataFrame:
    return label_in(df, "period", periods)


def within_periods(df: DataFrame, date_column: str, calendar: DataFrame, periods: Sequence[str]) -> DataFrame:
    """``with_period`` and ``in_periods`` in one. The first and last day of the
    periods bound the dates first, as scalar subqueries: Spark finds them when the query
    runs and hands them to the scan, which skips folders and row groups of other days."""
    days = calendar.where(F.col("period").isin(list(periods)))
    first, last = (days.agg(pick(F.to_date("dates"))).scalar() for pick in (F.min, F.max))
    rows = df.where((F.col(date_column) >= first) & (F.col(date_column) < F.date_add(last, 1)))
    return in_periods(with_period(rows, date_column, calendar), periods)


def by_month(df: DataFrame, date_column: str, calendar: DataFrame) -> DataFrame:
    """A fact staged in folders by the period of a date, for reports of some periods out of
    many: ``of_periods`` reads their folders only. Rows of days without a period are left out."""
    known = with_period(df, date_column, calendar).where(F.col("period").isNotNull())
    return stage(known, "periods", ["period"])


def of_periods(staged: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``by_month`` whose period is among those of a small frame, which a filter
    of the calendar makes. Spark reads that frame first and then the folders it names
    (dynamic partition pruning)."""
    return staged.join(F.broadcast(wanted.select("period").distinct()), "period", "left_semi")


def claim_counts(claims: DataFrame, dim: str) -> DataFrame:
    """Claims by provider, period and one dimension."""
    return distinct_by(claims, [PROVIDER, "period", dim], "claim_no", "claims")


def claim_counts_by(claims: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``claim_counts`` for each of several dimensions, with the claims read once:
    dimension, its value as text, provider, period, claims."""
    sets = [[PROVIDER, "period", d] for d in dims]
    # Rows are made distinct first, so that the copies per dimension are of claims, not of their lines.
    once = claims.select(PROVIDER, "period", "claim_no", *dims).distinct()
    counted = once.groupingSets(sets, PROVIDER, "period", *dims).agg(F.countDistinct("claim_no").alias("claims"), *_set_columns(dims))
    return counted.select("dimension", "value", PROVIDER, "period", "claims")


def _set_columns(dims: Sequence[str]) -> list[Column]:
    """Aggregates: which of the dimensions a row of grouping sets is for, and its value as text."""
    own = [F.grouping(d) == 0 for d in dims]
    name = F.coalesce(*[F.when(test, F.lit(d)) for d, test in zip(dims, own)])
    value = F.coalesce(*[F.when(test, F.col(d).cast("string")) for d, test in zip(dims, own)])
    return [name.alias("dimension"), value.alias("value")]


def money_reports(lines: DataFrame, claims: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``money_report`` for each of several dimensions of the same claims, which meet the
    lines once: dimension, its value as text, provider, period, total_payment."""
    total, joined = money_parts(lines, claims, [PROVIDER, *dims])
    sets = [[PROVIDER, "period", d] for d in dims]
    summed = joined.groupingSets(sets, PROVIDER, "period", *dims).agg(total.alias("total_payment"), *_set_columns(dims))
    return summed.select("dimension", "value", PROVIDER, "period", "total_payment")


def of_dimension(reports: DataFrame, dim: str) -> DataFrame:
    """The report of one dimension, as ``claim_counts`` or ``money_report`` would give it."""
    own = reports.where(F.col("dimension") == dim).drop("dimension").withColumnRenamed("value", dim)
    return own.select(PROVIDER, "period", dim, own.columns[-1])


def one_per_claim(claims: DataFrame, order_by: OrderBy) -> DataFrame:
    return keep_first(claims, "claim_no", order_by)


def money_report(lines: DataFrame, claims: DataFrame, dim: str) -> DataFrame:
    """Money by the claim's provider, the line's period and one dimension. The
    lines carry their period, see ``within_periods``."""
    return money_by(lines, claims, [PROVIDER, dim])


def key_pairs(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """The encounter a line names beside the one its claim names. ``claims`` has
    one row per claim."""
    named = claims.select("claim_no", F.col("encounter_id").alias("claim_encounter_id"))
    joined = salted_join(lines, named, "claim_no", "left", unique_right=True)
    return joined.select("encounter_id", "claim_encounter_id")


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(PROVIDER, "period")
