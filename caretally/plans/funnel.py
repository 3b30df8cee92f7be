"""Booking-channel funnel: log, invoices, conversions, cohorts and their billing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.functions.dates import BAD_DATE, NO_NOTES, or_marker, parse_month_first, standard_date, until, week_bucket
from caretally.functions.text import DOB, LOG_FIELDS, first_match, new_value, parsed_log
from caretally.operators.aggs import money
from caretally.operators.dedup import keep_first, keep_last
from caretally.operators.filters import label_in
from caretally.operators.lists import SET_VALUES, distinct_entries, list_entries, list_summary, set_summary, whole_summary
from caretally.operators.sequence import masked_conversions, visit_sequence
from caretally.operators.skew import salted_join

# Fixed value: status of a visit that took place.
CHECKED_OUT = "CHK : Check Out"

LOG_ORDER = ("modify_date", "encounter_id")
VISIT_ORDER = ("appointment_date", "encounter_id")


# --- booking log -------------------------------------------------------------


def log_with_fields(log: DataFrame, fields: Sequence[str] = LOG_FIELDS) -> DataFrame:
    """The log with the new value of each field as a column."""
    parsed = log.withColumn("_parsed", parsed_log("log_details"))
    return parsed.select(*log.columns, *[new_value("_parsed", f).alias(f) for f in fields])


def site_log(log: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Entries of the chosen sites, with the date of birth found in the notes."""
    return label_in(log, "FacilityName", sites).withColumn("dob", first_match("Notes", DOB))


def log_rows(log: DataFrame) -> DataFrame:
    """The log as a report shows it: a marker in place of the date of birth where there are no notes."""
    empty = F.coalesce(F.trim("Notes") == "", F.lit(True))
    return log.withColumn("dob", F.when(empty, F.lit(NO_NOTES)).otherwise(F.col("dob")))


def last_entries(log: DataFrame) -> DataFrame:
    """The latest entry per patient."""
    return keep_last(log, "patient_id", LOG_ORDER)


LOG_LISTS = {"reasons": "Reason", "visit_statuses": "VisitStatus"}


def log_entries(log: DataFrame, **size) -> DataFrame:
    """Reason and status of every entry, by patient and position."""
    lists = {n: F.concat(F.col(c), F.lit("// ")) for n, c in LOG_LISTS.items()}
    return list_entries(log, ["patient_id"], lists, LOG_ORDER, **size)


def log_summary(entries: DataFrame, page_rows: int | None = None) -> DataFrame:
    """Per patient: number of entries and, as text, the reasons and statuses in order; with
    ``page_rows`` only of patients with no more entries than that."""
    if page_rows is None:
        return whole_summary(entries, ["patient_id"], list(LOG_LISTS), count="billed_times")
    return list_summary(entries, ["patient_id"], list(LOG_LISTS), count="billed_times", page_rows=page_rows)


# --- invoices ----------------------------------------------------------------

INVOICE_DATES = ("PatientDateOfBirth", "AppointmentTime", "BookingTime")


def standard_invoices(raw: DataFrame) -> DataFrame:
    """The three date columns as ``MM/dd/yyyy``; null where the text is no date."""
    return raw.withColumns({c: standard_date(c) for c in INVOICE_DATES})


def invoices_until(invoices: DataFrame, cutoff: str, mode: str = "date") -> DataFrame:
    """Bookings up to the cut-off, with day, month and part of the month."""
    booked = parse_month_first("BookingTime")
    rows = invoices.where(until("BookingTime", cutoff, mode))
    return rows.withColumns({"day": F.dayofmonth(booked), "month": F.month(booked)}).withColumn(
        "week", week_bucket("day")
    )


def invoice_rows(invoices: DataFrame) -> DataFrame:
    """The invoices as a report shows them: a marker in place of what is no date."""
    return invoices.withColumns({c: or_marker(c, BAD_DATE) for c in INVOICE_DATES})


def is_billed() -> Column:
    return F.col("Premium") == "Yes"


def billed(invoices: DataFrame) -> DataFrame:
    return invoices.where(is_billed())


def billed_entries(invoices: DataFrame, order_by: Sequence[str], show: Sequence[str] = (), **size) -> DataFrame:
    """The names used by each e-mail, by position, with the columns to show."""
    name = F.concat(F.col("PatientFirstName"), F.lit(" "), F.col("PatientLastName"))
    return list_entries(billed(invoices), ["PatientEmail"], {"names": name}, order_by, first=show, **size)


def billed_users(entries: DataFrame, show: Sequence[str] = ()) -> DataFrame:
    """Per e-mail: columns of its first invoice and all names used."""
    return whole_summary(entries, ["PatientEmail"], ["names"], first=show)


def users_by_week(users: DataFrame) -> DataFrame:
    return users.groupBy("week").agg(F.count("week").alias("times"))


# --- conversions -------------------------------------------------------------


def log_encounters(log: DataFrame, encounters: DataFrame, **size) -> DataFrame:
    """The log with the encounter each entry led to, if any."""
    found = encounters.select(
        "encounter_id",
        F.col("encounter_id").alias("matched_encounter_id"),
        "visit_status",
        F.col("appointment_date").alias("encounter_date"),
        "appointment_provider_name",
    )
    return salted_join(log, found, "encounter_id", "left", **size)


def matched(joined: DataFrame) -> DataFrame:
    return joined.where(F.col("matched_encounter_id").isNotNull())


def converted_entries(joined: DataFrame, status: str = CHECKED_OUT, show: Sequence[str] = (), **size) -> DataFrame:
    """Every checked-out visit, by patient and position."""
    rows = matched(joined).where(F.col("visit_status") == status)
    return list_entries(rows, ["patient_id"], {"patient_ids": F.col("patient_id")}, VISIT_ORDER, first=show, **size)


def converted_users(entries: DataFrame, show: Sequence[str] = ()) -> DataFrame:
    """Per patient with a checked-out visit: columns of the first one, their number and the whole list of ids."""
    return whole_summary(entries, ["patient_id"], ["patient_ids"], first=show)


def sequence(joined: DataFrame, status: str = CHECKED_OUT, **size) -> DataFrame:
    return visit_sequence(
        matched(joined), ["patient_id", "dob"], VISIT_ORDER, F.col("visit_status") == status, **size
    )


def conversions(seq: DataFrame, **size) -> DataFrame:
    return masked_conversions(seq, ["patient_id"], VISIT_ORDER, **size)


def one_per_patient(masked: DataFrame) -> DataFrame:
    return keep_first(masked, "patient_id", VISIT_ORDER)


def converted_encounter_entries(masked: DataFrame, **size) -> DataFrame:
    """The distinct encounters of each converted patient, by position."""
    return distinct_entries(masked, ["patient_id"], F.col("encounter_id"), "encounter_ids", **size)


def converted_encounters(entries: DataFrame) -> DataFrame:
    """Per converted patient: number and whole list of the distinct encounters."""
    return whole_summary(entries, ["patient_id"], ["encounter_ids"], count="encounters")


# --- since the first booking -------------------------------------------------


def first_seen(log: DataFrame) -> DataFrame:
    """The earliest booked appointment per patient."""
    return keep_first(log.select("patient_id", "appointment_date", "encounter_id"), "patient_id", VISIT_ORDER).select(
        "patient_id", F.col("appointment_date").alias("first_seen")
    )


def with_first_seen(rows: DataFrame, log: DataFrame, **size) -> DataFrame:
    return salted_join(rows, first_seen(log), "patient_id", "left", unique_right=True, **size)


def visits_since_first(visits: DataFrame, users: DataFrame, status: str = CHECKED_OUT, **size) -> DataFrame:
    """Checked-out visits on or after the first booking of a converted patient.

    ``users`` has one row per patient, with ``first_seen``.
    """
    rows = visits.where(F.col("visit_status") == status)
    joined = salted_join(rows, users, "patient_id", "inner", unique_right=True, **size)
    return joined.where(F.col("appointment_date") >= F.col("first_seen"))


def cohort_validator(visits: DataFrame, set_values: int = SET_VALUES) -> DataFrame:
    """Per patient: new-patient visits, first booking, visit types."""
    measures = {"validator": (F.col("np_flag").cast("long"), F.sum), "first_seen": (F.col("first_seen"), F.min)}
    return set_summary(visits, ["patient_id"], measures, {"visit_types": F.col("visit_type")}, set_values=set_values)


def cohort(validator: DataFrame, which: str, rule: str = "one") -> DataFrame:
    """``new`` or ``established`` patients. By rule ``one`` a new patient has
    exactly one new-patient visit, by ``nonzero`` any number but 0."""
    tests = {
        ("new", "one"): F.col("validator") == 1,
        ("new", "nonzero"): F.col("validator") != 0,
        ("established", "one"): F.col("validator") == 0,
        ("established", "nonzero"): F.col("validator") == 0,
    }
    return validator.where(tests[which, rule])


def billing_since_first(visits: DataFrame, claim_map: DataFrame, claims: DataFrame, **size) -> DataFrame:
    """Distinct charges of the visits, served on or after the first booking."""
    mapped = salted_join(visits, claim_map.select("encounter_id", "claim_no"), "encounter_id", "inner", **size)
    charges = claims.select("claim_no", "service_date", "payment", "billed_charge")
    joined = salted_join(mapped, charges, "claim_no", "inner", **size)
    return joined.where(F.col("service_date") >= F.col("first_seen")).drop("service_date").distinct()


def cohort_visits(visits: DataFrame, members: DataFrame, **size) -> DataFrame:
    """One row per visit of a cohort's patient: the cohort row and the start date."""
    starts = visits.select("patient_id", F.col("first_seen").alias("start_date"), F.col("encounter_id").alias("_visit"))
    # The visit's id keeps the rows of a patient apart, for the salt.
    return salted_join(starts, members, "patient_id", "inner", unique_right=True, **size).drop("_visit")


def cohort_billing(billing: DataFrame, members: DataFrame, **size) -> DataFrame:
    return salted_join(billing, members.select("patient_id"), "patient_id", "left_semi", **size)


def billing_totals(billing: DataFrame, validator: DataFrame, rule: str = "one") -> DataFrame:
    """Payments in all, of new and of established patients. Charges are summed
    per patient before they meet the cohort flag."""
    per_patient = billing.groupBy("patient_id").agg(F.sum(money("payment")).alias("_paid"))
    flag = validator.select("patient_id", "validator")
    joined = per_patient.join(flag, "patient_id", "left")
    is_new = (F.col("validator") == 1) if rule == "one" else (F.col("validator") != 0)

    def total(test: Column | None, name: str) -> Column:
        paid = F.col("_paid") if test is None else F.when(test, F.col("_paid"))
        return F.sum(paid).cast("double").alias(name)

    return joined.agg(
        total(None, "total_payment"),
        total(is_new, "new_payment"),
        total(F.col("validator") == 0, "established_payment"),
    )


# --- reasons -----------------------------------------------------------------


def cohort_last_entries(members: DataFrame, log: DataFrame) -> DataFrame:
    """Each member with the patient's last log entry, null if there is none."""
    return members.select("patient_id").join(last_entries(log), "patient_id", "left")


def reason_share(all_last: DataFrame, new_last: DataFrame) -> DataFrame:
    """Bookings and new patients per reason. A reason without new patients shows
    0. The null reason counts no bookings (only named reasons are counted) and
    finds no partner."""
    booked = all_last.groupBy("Reason").agg(F.count("Reason").alias("booked"))
    new = new_last.groupBy("Reason").agg(F.count("*").alias("new_patients"))
    return booked.join(new, "Reason", "left").na.fill(0, subset=["booked", "new_patients"])


def reasons_in_order(share: DataFrame) -> DataFrame:
    return share.orderBy(F.desc("booked"))
