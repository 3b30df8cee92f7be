"""Provider scorecard: clinic visits and hospital procedures, stacked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.functions.text import contains_none, like_any_case
from caretally.operators.aggs import money
from caretally.operators.filters import without_nulls
from caretally.operators.skew import lookup_join

CALENDAR = ("calendar_period", "calendar_week", "calendar_year")


def _calendar(df: DataFrame, weeks: DataFrame) -> DataFrame:
    return lookup_join(df, weeks.select("calendar_week_id", *CALENDAR), "calendar_week_id")


def claims_star(
    claims: DataFrame,
    weeks: DataFrame,
    facilities: DataFrame,
    insurance: DataFrame,
    providers: DataFrame,
    visit_types: DataFrame,
) -> DataFrame:
    """Claims with the columns of their five dimensions."""
    star = _calendar(claims, weeks)
    star = lookup_join(star, facilities.select("facility_group_id", "facility_group_name"), "facility_group_id")
    star = lookup_join(star, insurance.select("primary_insurance_id", "primary_insurance_class"), "primary_insurance_id")
    star = lookup_join(star, providers.select("resource_provider_id", "resource_provider_name"), "resource_provider_id")
    return lookup_join(star, visit_types.select("visit_type_id", "visit_type"), "visit_type_id")


def procedure_star(
    procedures: DataFrame,
    weeks: DataFrame,
    visit_types: DataFrame,
    cpts: DataFrame,
    facilities: DataFrame,
    providers: DataFrame,
    insurance: DataFrame,
    year: str,
) -> DataFrame:
    """Procedures of a year with six dimensions. The provider is the one the
    procedure is allocated to, not the one seen."""
    allocated = providers.select(F.col("resource_provider_id").alias("cpt_provider_allocated_id"), "resource_provider_name")
    star = _calendar(procedures, weeks).where(F.col("calendar_year") == year)
    star = lookup_join(star, visit_types.select("visit_type_id", "visit_type", "visit_type_description"), "visit_type_id")
    star = lookup_join(star, cpts.select("cpt_id", "cpt_group", "cpt_description"), "cpt_id")
    star = lookup_join(star, facilities.select("facility_group_id", "facility_group_name"), "facility_group_id")
    star = lookup_join(star, allocated, "cpt_provider_allocated_id")
    return lookup_join(
        star,
        insurance.select(
            "primary_insurance_id", "primary_insurance_class", "primary_insurance_group", "primary_insurance_name"
        ),
        "primary_insurance_id",
    )


def clinic_rows(star: DataFrame, year: str, site_prefix: str) -> DataFrame:
    """Billable claims of the clinic sites in a year, with class and visit type known."""
    rows = star.where(
        like_any_case("facility_group_name", f"{site_prefix}%")
        & (F.col("is_billable") == 1)
        & (F.col("calendar_year") == year)
    )
    return without_nulls(rows, ["primary_insurance_class", "visit_type"])


def hospital_rows(star: DataFrame, clinic_prefix: str, excluded: Sequence[str]) -> DataFrame:
    """Billable procedures elsewhere, without the descriptions named."""
    rows = star.where(
        (F.col("is_billable") == 1)
        & contains_none("facility_group_name", [f"{clinic_prefix}%"])
        & contains_none("cpt_description", [f"%{word}%" for word in excluded])
    )
    return without_nulls(rows, ["visit_type"])


def scorecard(rows: DataFrame, visit_type: str, location: str) -> DataFrame:
    """Visits, revenue and new patients by provider, time, complexity, insurance
    class and visit type (for hospitals: the procedure group)."""
    return (
        rows.groupBy(
            F.col("resource_provider_name").alias("provider"),
            F.col("calendar_period").alias("period"),
            F.col("calendar_year").alias("year"),
            F.col("calendar_week").alias("week"),
            "complexity_level",
            "primary_insurance_class",
            F.col(visit_type).alias("visit_type"),
        )
        .agg(
            F.sum("is_billable").cast("long").alias("visits"),
            F.round(F.sum(money("payment")), 0).cast("double").alias("revenue"),
            F.sum("new_patient").cast("long").alias("new_patients"),
        )
        .withColumn("location", F.lit(location))
    )


def stacked(clinic: DataFrame, hospital: DataFrame) -> DataFrame:
    return clinic.unionByName(hospital, allowMissingColumns=True)


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.asc_nulls_last("provider"), F.asc_nulls_last("period"))
