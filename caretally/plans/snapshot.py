"""Appointments of a date window with the patient's insurance."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caretally.functions.dates import in_range
from caretally.operators.dedup import keep_last
from caretally.operators.skew import lookup_join, salted_join

VISIT_COLUMNS = ("facility_group_name", "general_visit_status_id", "is_new_patient", "appointment_date")


def visits_in_window(
    visits: DataFrame, facilities: DataFrame, start: date, end: date, statuses: Sequence[int] | None = None
) -> DataFrame:
    """Visits from ``start`` up to, not including, ``end``, with the facility name.

    All statuses are kept unless some are named.
    """
    rows = visits.where(in_range("appointment_date", start, end))
    if statuses:
        rows = rows.where(F.col("general_visit_status_id").isin(list(statuses)))
    return lookup_join(rows, facilities.select("facility_group_id", "facility_group_name"), "facility_group_id")


def claims_with_insurance(claims: DataFrame, insurance: DataFrame) -> DataFrame:
    return lookup_join(
        claims, insurance.select("primary_insurance_id", "primary_insurance_class"), "primary_insurance_id"
    )


def visit_claims(visits: DataFrame, claims: DataFrame, **size) -> DataFrame:
    """Every visit with every claim of its patient; a missing insurance is 0."""
    joined = salted_join(visits, claims, "patient_id", "left", **size)
    return joined.na.fill({"primary_insurance_id": 0})


def with_class_codes(claims: DataFrame, insurance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims with ``_class``, the place of their class among all classes in the order of the
    text, and the table (_class, class) of these places. The greatest place is that of the greatest text,
    and a number is aggregated by hash, where a text would be sorted."""
    names = insurance.select("primary_insurance_class").where("primary_insurance_class IS NOT NULL").distinct()
    places = names.withColumn("_class", F.row_number().over(W.orderBy("primary_insurance_class")))  # one row per class
    ids = insurance.join(places, "primary_insurance_class").select("primary_insurance_id", "_class")
    return lookup_join(claims, ids, "primary_insurance_id"), places


def patient_snapshot(
    visits: DataFrame, claims: DataFrame, insurance: DataFrame, tie_break: Sequence[str] = ("encounter_id",)
) -> DataFrame:
    """One row per patient with a visit.

    The visit shown is the latest. ``max_*`` are the greatest insurance id and
    the greatest class among the patient's claims, each for itself; ``latest_*``
    belong to the claim last served. The claims are reduced to one row per
    patient before the join, so visits are never multiplied; claims of patients
    without a visit are left out before they are gathered.

    ``insurance`` has one row per id. Classes are numbers until the last step, and the
    latest claim is the first of an order, of which a task keeps one row per patient.
    """
    last_visit = keep_last(visits, "patient_id", ["appointment_date", *tie_break])
    claims = claims.join(visits.select("patient_id").distinct(), "patient_id", "left_semi")
    coded, places = with_class_codes(claims.select("patient_id", "service_date", "claim_no", "primary_insurance_id"), insurance)
    most = coded.groupBy("patient_id").agg(
        F.max(F.coalesce(F.col("primary_insurance_id"), F.lit(0))).alias("max_insurance_id"), F.max("_class").alias("_most")
    )
    last = keep_last(coded, "patient_id", ["service_date", "claim_no", "primary_insurance_id"])
    latest = last.select("patient_id", F.col("primary_insurance_id").alias("latest_insurance_id"), F.col("_class").alias("_latest"))

    def named(code: str, name: str) -> DataFrame:
        return places.select(F.col("_class").alias(code), F.col("primary_insurance_class").alias(name))

    insured = most.join(latest, "patient_id")
    joined = last_visit.join(insured, "patient_id", "left")
    joined = lookup_join(lookup_join(joined, named("_most", "max_insurance_class"), "_most"), named("_latest", "latest_insurance_class"), "_latest")
    return joined.select(
        "patient_id",
        *VISIT_COLUMNS,
        F.coalesce("max_insurance_id", F.lit(0)).alias("max_insurance_id"),
        "max_insurance_class",
        "latest_insurance_id",
        "latest_insurance_class",
    )


def site_report(snapshot: DataFrame, sites: Sequence[str]) -> DataFrame:
    return snapshot.where(F.col("facility_group_name").isin(list(sites)))


def in_report_order(snapshot: DataFrame) -> DataFrame:
    """By facility and class. The patient breaks ties, so that the sort can cut a
    facility with many patients into several ranges."""
    return snapshot.orderBy("facility_group_name", "max_insurance_class", "patient_id")
