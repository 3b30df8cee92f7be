"""Whole reports: sources in, every derived table out.

Each job takes its inputs as DataFrames and returns the report tables by name. A
frame that feeds several tables is staged once. Run one from a file of settings:

    python -m caretally.jobs settings.json

    {"job": "labs",
     "sources": {"raw": {"kind": "csv", "path": "labs.csv", "schema": "LABS", "encoding": "ISO-8859-1"}},
     "params": {"year": 2023, "month": 11, "in_house_ids": [1, 2]},
     "output": {"path": "reports/labs", "kind": "csv"}}
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretally.operators.dedup import claim_map
from caretally.operators.ledger import Ledger
from caretally.operators.sequence import ordinal_mix
from caretally.operators.skew import hot_keys, stage_by
from caretally.plans import documents, fiscal, funnel, labs, scorecard, snapshot
from caretally.session import stage
from caretally.sources import readers, schemas, sinks

Tables = dict[str, DataFrame]


def _day(value: str | date) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def snapshot_job(
    visits: DataFrame,
    facility_group: DataFrame,
    claims: DataFrame,
    primary_insurance: DataFrame,
    *,
    start: str | date,
    end: str | date,
    sites: Sequence[str],
    statuses: Sequence[int] | None = None,
) -> Tables:
    window = stage(snapshot.visits_in_window(visits, facility_group, _day(start), _day(end), statuses), "window")
    shown = window.select("patient_id", "encounter_id", *snapshot.VISIT_COLUMNS)
    users = stage(snapshot.patient_snapshot(shown, claims, primary_insurance), "users")
    return {
        "visits": window,
        "users": snapshot.in_report_order(users),
        "site_users": snapshot.in_report_order(snapshot.site_report(users, sites)),
    }


def fiscal_job(
    visits: DataFrame,
    applied_revenue: DataFrame,
    claims_with: DataFrame,
    claims_without: DataFrame,
    calendar: DataFrame,
    *,
    periods: Sequence[str],
    claim_order: Sequence[str],
) -> Tables:
    def kept(df: DataFrame, day: str) -> DataFrame:
        return fiscal.within_periods(df, day, calendar, periods)

    revenue = stage(kept(applied_revenue, "service_date"), "revenue")
    collections = stage(kept(applied_revenue, "deposit_date"), "collections")
    single = stage(fiscal.one_per_claim(claims_with, claim_order), "single_claims")
    counted = kept(claims_with, "service_date")
    counted_without = kept(claims_without, "service_date")
    # Dimensions of the same claims share one scan, and one join with the money.
    by_claim, dims = ["payer_class", "quality_level"], ["quality_level", "visit_type_classification"]
    counts_with = stage(fiscal.claim_counts_by(counted, by_claim), "claim_counts")
    money = {}
    for name, lines in (("revenue", revenue), ("collections", collections)):
        reports = stage(fiscal.money_reports(lines, claims_without, dims), f"{name}_reports")
        money |= {
            f"{name}_by_payer": fiscal.money_report(lines, single, "payer_class"),
            f"{name}_by_quality": fiscal.of_dimension(reports, "quality_level"),
            f"{name}_by_visit_type": fiscal.of_dimension(reports, "visit_type_classification"),
        }
    counts = {
        "claims_by_payer": fiscal.of_dimension(counts_with, "payer_class"),
        "claims_by_quality": fiscal.of_dimension(counts_with, "quality_level"),
        "claims_by_visit_type": fiscal.claim_counts(counted_without, "visit_type_classification"),
    }
    return {
        "checked_out_visits": fiscal.with_period(fiscal.checked_out(visits), "appointment_date", calendar),
        "key_pairs": fiscal.key_pairs(revenue, single),
        **{n: fiscal.in_report_order(df) for n, df in (counts | money).items()},
    }


def scorecard_job(
    claims: DataFrame,
    procedures: DataFrame,
    calendar_week: DataFrame,
    facility_group: DataFrame,
    primary_insurance: DataFrame,
    resource_provider: DataFrame,
    visit_type: DataFrame,
    cpt: DataFrame,
    *,
    year: str,
    clinic_prefix: str,
    excluded: Sequence[str],
) -> Tables:
    star = scorecard.claims_star(
        claims, calendar_week, facility_group, primary_insurance, resource_provider, visit_type
    )
    done = scorecard.procedure_star(
        procedures, calendar_week, visit_type, cpt, facility_group, resource_provider, primary_insurance, year
    )
    clinic = scorecard.scorecard(scorecard.clinic_rows(star, year, clinic_prefix), "visit_type", "CLINIC")
    hospital = scorecard.scorecard(scorecard.hospital_rows(done, clinic_prefix, excluded), "cpt_group", "HOSPITAL")
    clinic, hospital = stage(clinic, "clinic"), stage(hospital, "hospital")
    return {
        "clinic": clinic,
        "hospital": hospital,
        "scorecard": scorecard.in_report_order(scorecard.stacked(clinic, hospital)),
    }


def documents_job(
    raw: DataFrame,
    report: DataFrame,
    *,
    year: int,
    month: int,
    reviewer_ids: Sequence[int],
    limit: int = 5,
) -> Tables:
    ledger = Ledger()
    bad = F.count_if(F.col("scanDate").isNotNull() & F.col("_parsed").isNull())
    # Rows that no month can claim: their scan date is no date.
    read = ledger.watch(raw.withColumn("_parsed", documents.parse_stamp("scanDate")), "documents", rows=F.count("*"), bad_dates=bad)
    typed = documents.typed_documents(read)
    order = ["scan_date", "patient_id", "file_name"]
    assigned = stage(
        documents.assigned_documents(documents.month_of_documents(typed, year, month), reviewer_ids, order), "assigned"
    )
    listed = documents.typed_report(report)
    lags = stage(documents.review_lags(assigned, listed, ["reviewed_date", "report_scanned_by"], limit), "review_lags")
    return {
        "review_lags": lags,
        "reviewers": documents.in_report_order(documents.reviewer_sla(lags)),
        "unreviewed": documents.unreviewed(assigned),
        "metrics": ledger.rows(raw.sparkSession),
    }


def labs_job(
    raw: DataFrame,
    *,
    year: int,
    month: int,
    in_house_ids: Sequence[int],
    run_time: str | datetime | None = None,
) -> Tables:
    when = datetime.fromisoformat(run_time) if isinstance(run_time, str) else run_time
    ledger = Ledger()
    # Rows that no month can claim: their result date is no date.
    bad = F.count_if(F.col("ResultDate").isNotNull() & F.col("_parsed").isNull())
    read = ledger.watch(raw.withColumn("_parsed", labs.parse_stamp("ResultDate")), "extract", rows=F.count("*"), bad_dates=bad)
    sliced = labs.month_of_results(labs.typed_labs(read), year, month)
    flagged = labs.report_rows(labs.with_same_day(labs.with_lags(sliced, in_house_ids, when)))
    # One scan makes the folders that every split is read from.
    frame = ledger.stage(flagged, "labs", partition_by=labs.SPLIT_COLUMNS, labs=F.count("*"))
    splits = {name: labs.split(frame, name) for name in labs.SPLITS}
    per_encounter = ledger.stage(labs.encounter_summary(frame), "encounters", encounters=F.count("encounter_id"))
    unreviewed = labs.answered_unreviewed(splits["answered"])
    return {
        "labs": frame,
        **splits,
        "split_counts": labs.split_counts(frame),
        "outcomes": labs.outcome_counts(frame),
        "encounters": per_encounter,
        "lag_histogram": labs.lag_histogram(splits["answered"]),
        "reviewers": labs.reviewer_summary(splits["answered"]),
        "reviewer_staff": labs.reviewer_staff(splits["answered"]),
        "reviewer_buckets": labs.in_report_order(labs.reviewer_buckets(splits["answered"])),
        "reviewer_bucket_detail": labs.bucket_detail(splits["answered"]),
        "answered_unreviewed": unreviewed,
        "unreviewed_queue": labs.pending_queue(unreviewed),
        "waiting_queue": labs.pending_queue(splits["waiting"]),
        "encounters_not_same_day": labs.encounter_summary(splits["not_same_day"]),
        "encounters_answered": labs.encounter_summary(splits["answered"]),
        "encounters_waiting": labs.encounter_counts(splits["waiting"]),
        "metrics": ledger.rows(raw.sparkSession),
    }


def funnel_job(
    log: DataFrame,
    invoices: DataFrame,
    encounters: DataFrame,
    visits: DataFrame,
    claims_with: DataFrame,
    claims_without: DataFrame,
    *,
    sites: Sequence[str],
    cutoff: str,
    cutoff_mode: str = "date",
    rule: str = "one",
    invoice_order: Sequence[str] = ("BookingTime", "AppointmentTime", "PatientFirstName", "PatientLastName"),
) -> Tables:
    ledger = Ledger()
    count = {"rows": F.count("*")}
    whole = stage(funnel.log_with_fields(log), "log")
    chosen = stage(funnel.site_log(whole, sites), "site_log")
    entries = ledger.stage(funnel.log_entries(chosen), "log_entries", **count)
    # One row per patient of the log, whom the join with the encounters keeps.
    summary = ledger.stage(funnel.log_summary(entries), "log_summary", patients=F.count("patient_id"))
    joined = ledger.stage(funnel.log_encounters(chosen, encounters), "log_encounters", **count)
    # A patient's rows only get fewer from here on.
    hot = hot_keys(joined, ["patient_id"])
    sequence = stage(funnel.sequence(joined, hot=hot), "sequence")
    masked = ledger.stage(funnel.conversions(sequence, hot=hot), "conversions", **count)
    first = ledger.stage(funnel.with_first_seen(funnel.one_per_patient(masked), whole), "converted", patients=F.count("patient_id"))
    shown = first.select("patient_id", "first_seen", "Reason", "FacilityName", "VisitStatus")
    since = ledger.stage(funnel.visits_since_first(visits, shown), "visits_since_first", **count)
    # Cohorts, totals and visits per patient read these as they lie, in buckets of the patient.
    per_patient = stage_by(since, "since", ["patient_id"])
    validator = ledger.stage(funnel.cohort_validator(per_patient), "validator", patients=F.count("patient_id"))
    billing = ledger.stage(funnel.billing_since_first(since, claim_map(claims_with), claims_without), "billing", **count)
    charges = stage_by(billing, "billing", ["patient_id"])
    flags = stage_by(validator, "validator", ["patient_id"])
    members = {which: funnel.cohort(flags, which, rule) for which in ("new", "established")}
    # Control totals: the join by reason loses no booking.
    reasons_new = ledger.stage(
        funnel.cohort_last_entries(funnel.cohort(validator, "new", "nonzero"), chosen), "new_entries", new_patients=F.count("*")
    )
    reasons_all = ledger.stage(funnel.last_entries(chosen), "last_entries", booked=F.count("Reason"))
    reasons = ledger.stage(
        funnel.reason_share(reasons_all, reasons_new), "reasons", booked=F.sum("booked"), new_patients=F.sum("new_patients")
    )

    bad = F.count_if(F.col("BookingTime").isNull())
    standard = ledger.watch(funnel.standard_invoices(invoices), "invoices", bad_dates=bad)
    kept = ledger.stage(funnel.invoices_until(standard, cutoff, cutoff_mode), "billed", rows=F.count_if(funnel.is_billed()))
    names = stage(funnel.billed_entries(kept, invoice_order, show=["week"]), "billed_entries")
    users = ledger.stage(funnel.billed_users(names, show=["week"]), "billed_users", rows=F.count("PatientEmail"))
    converted = stage(funnel.converted_entries(joined), "converted_entries")
    converted_encounters = stage(funnel.converted_encounter_entries(masked), "converted_encounters")
    return {
        "log": funnel.log_rows(chosen),
        "log_last": reasons_all,
        "log_entries": entries,
        "log_summary": summary,
        "invoices": funnel.invoice_rows(kept),
        "billed_entries": names,
        "billed_users": users,
        "billed_by_week": funnel.users_by_week(users),
        "log_encounters": joined,
        "converted_entries": converted,
        "converted_users": funnel.converted_users(converted),
        "sequence": sequence,
        "conversions": masked,
        "ordinal_mix": ordinal_mix(masked),
        "converted_encounter_entries": converted_encounters,
        "converted_encounters": funnel.converted_encounters(converted_encounters),
        "converted": first,
        "visits_since_first": since,
        "validator": validator,
        "billing": billing,
        "billing_totals": funnel.billing_totals(charges, flags, rule),
        **{f"{which}_visits": funnel.cohort_visits(per_patient, m) for which, m in members.items()},
        **{f"{which}_billing": funnel.cohort_billing(charges, m) for which, m in members.items()},
        "new_patient_entries": reasons_new,
        "reasons": funnel.reasons_in_order(reasons),
        "metrics": ledger.rows(log.sparkSession),
    }


def copy_job(table: DataFrame) -> Tables:
    return {"copy": table}


JOBS: dict[str, Callable[..., Tables]] = {
    "snapshot": snapshot_job,
    "fiscal": fiscal_job,
    "scorecard": scorecard_job,
    "documents": documents_job,
    "labs": labs_job,
    "funnel": funnel_job,
    "copy": copy_job,
}


def open_source(spark: SparkSession, settings: Mapping, name: str = "source", ledger: Ledger | None = None) -> DataFrame:
    """A reader from its settings; ``schema`` names one of the declared schemas. Rows and
    malformed rows of a CSV source with a schema are counted in the ledger as it is read."""
    kinds = {"jdbc": readers.Jdbc, "csv": readers.Csv, "parquet": readers.Parquet, "table": readers.Table}
    args = {k: v for k, v in settings.items() if k != "kind"}
    if "schema" in args:
        args["schema"] = getattr(schemas, args["schema"])
    source = kinds[settings["kind"]](**args)
    if ledger is None or settings["kind"] != "csv" or "schema" not in args:
        return source.read(spark)
    marked = source.read_marked(spark)
    malformed = readers.count_malformed(marked)
    return ledger.watch(marked, name, rows=F.count("*"), malformed_rows=malformed).drop(readers.MALFORMED)


def publish(tables: Tables, output: Mapping) -> None:
    """Save as tables of a database, or as one report folder per table."""
    for name, df in tables.items():
        if "database" in output:
            sinks.save_table(df, f"{output['database']}.{name}")
        else:
            sinks.write_report(df, f"{output['path']}/{name}", output.get("kind", "csv"))


def run(spark: SparkSession, settings: Mapping) -> Tables:
    """Reads, computes and publishes; with CSV sources also ``source_metrics``, known once all is read."""
    ledger = Ledger()
    inputs = {name: open_source(spark, s, name, ledger) for name, s in settings["sources"].items()}
    tables = JOBS[settings["job"]](**inputs, **settings.get("params", {}))
    publish(tables, settings["output"])
    if ledger:
        tables["source_metrics"] = ledger.rows(spark)
        publish({"source_metrics": tables["source_metrics"]}, settings["output"])
    return tables


if __name__ == "__main__":
    with open(sys.argv[1]) as f:
        run(SparkSession.builder.appName("caretally").getOrCreate(), json.load(f))
