"""Whole reports, from files to files."""

import csv
import json

import pytest

from caretally import jobs
from caretally.plans import labs
from caretally.sources import schemas

NEVER = "Jan  1 1901 12:00AM"


def write_csv(path, columns, rows):
    with open(path, "w", newline="", encoding="latin-1") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for row in rows:
            out.writerow([row.get(c, "") for c in columns])
    return str(path)


def read_csv(spark, path):
    return [r.asDict() for r in spark.read.option("header", True).csv(str(path)).collect()]


def table(spark, name, schema, rows):
    spark.createDataFrame(rows, schema).write.mode("overwrite").saveAsTable(name)
    return {"kind": "table", "name": name}


def test_labs(spark, tmp_path):
    def lab(enc, item, by, result, reviewed, coll="Nov  1 2023  9:00AM"):
        return {"EncounterId": enc, "ItemId": item, "ReviewedBy": by, "assignedToId": "60", "ordPhyId": "70",
                "ordPhyName": "Kim", "collDate": coll, "ResultDate": result, "ReviewedDate": reviewed}

    path = write_csv(tmp_path / "labs.csv", schemas.LAB_COLUMNS, [
        lab("1", "5", "50", "Nov  1 2023 11:00AM", "Nov  2 2023 12:00PM"), lab("1", "6", "0", "Nov  3 2023 11:00AM", NEVER),
        lab("2", "6", "50", "Nov  3 2023 11:00AM", "Nov  7 2023 11:00AM"), lab("3", "6", "50", "Nov  3 2023 11:00AM", NEVER, ""),
        lab("4", "6", "50", "Oct  3 2023 11:00AM", NEVER)])
    out = tmp_path / "out"
    settings = {"job": "labs", "sources": {"raw": {"kind": "csv", "path": path, "schema": "LABS", "encoding": "ISO-8859-1"}},
                "params": {"year": 2023, "month": 11, "in_house_ids": [5], "run_time": "2023-12-01T00:00:00"},
                "output": {"path": str(out), "kind": "csv"}}
    tables = jobs.run(spark, json.loads(json.dumps(settings)))
    assert {r["metric"]: r["value"] for r in read_csv(spark, out / "metrics")} == {"labs": "4.0", "encounters": "3.0", "rows": "5.0", "bad_dates": "0.0"}
    assert {(r["stage"], r["metric"]): r["value"] for r in read_csv(spark, out / "source_metrics")} == {("raw", "rows"): "5.0", ("raw", "malformed_rows"): "0.0"}
    buckets = {r["reviewed_by"]: r for r in read_csv(spark, out / "reviewer_buckets")}
    assert (buckets["50"]["labs"], buckets["50"]["b1"], buckets["50"]["b2"], buckets["50"]["share_b2"]) == ("3", "1", "1", "0.33")
    assert read_csv(spark, out / "unreviewed_queue")[0]["labs"] == "1"
    assert [r["encounter_id"] for r in read_csv(spark, out / "encounters_waiting")] == ["3"]
    assert set(tables) == {
        "labs", "split_counts", "outcomes", "encounters", "lag_histogram", "reviewers", "reviewer_staff", "reviewer_buckets", "reviewer_bucket_detail",
        "answered_unreviewed", "unreviewed_queue", "waiting_queue", "encounters_not_same_day", "encounters_answered", "encounters_waiting", "metrics",
        "source_metrics", *labs.SPLITS}
    split = {name: sorted(r["encounter_id"] + r["item_id"] for r in read_csv(spark, out / name)) for name in labs.SPLITS}
    assert split == {
        "with_result": ["15", "16", "26"], "with_result_in_house": ["15"], "with_result_sent_out": ["16", "26"], "waiting": ["36"], "waiting_in_house": [],
        "waiting_sent_out": ["36"], "answered": ["15", "16", "26", "36"], "not_in_house": ["16", "26", "36"], "same_day_reviewed": ["15"],
        "not_same_day": ["16", "26", "36"]}
    counts = {r["split"]: (r["labs"], r["encounters"]) for r in read_csv(spark, out / "split_counts")}
    assert counts == {name: (str(len(keys)), str(len({k[0] for k in keys}))) for name, keys in split.items()}
    for name in labs.SPLITS:  # every split reads its own folders
        assert "PartitionFilters: [" in (plan := plan_of(tables[name])) and "PartitionFilters: []" not in plan
    lags = {r["encounter_id"] + r["item_id"]: (r["result_lag"], r["review_lag"]) for r in read_csv(spark, out / "labs")}
    assert lags == {"15": ("0 days 02:00:00", "1 days 01:00:00"), "16": ("2 days 02:00:00", "Sin revisión"),
                    "26": ("2 days 02:00:00", "4 days 00:00:00"), "36": (None, "Sin revisión")}


def test_documents(spark, tmp_path):
    def doc(number, reviewer, review, scanned, deleted="0"):
        return {"docID": number, "ReviewerId": reviewer, "reviewername": "R" + reviewer, "Review": review, "delFlag": deleted, "scanDate": scanned}

    raw = write_csv(tmp_path / "docs.csv", schemas.DOCUMENT_COLUMNS, [
        doc("1", "50", "1", "Nov  1 2023  9:00AM"), doc("2", "50", "0", "Nov  1 2023  9:00AM"), doc("3", "50", "1", "Nov 31 2023  9:00AM"),
        doc("4", "50", "1", "Nov  1 2023  9:00AM", "1"), doc("5", "99", "1", "Nov  1 2023  9:00AM")])
    report = write_csv(tmp_path / "report.csv", schemas.REPORT_COLUMNS, [
        {"Document ID": "1", "Reviewed Date": "06/11/2023", "Patient Acct No + Name": "7:Ñu"}])
    out = tmp_path / "out"
    jobs.run(spark, {"job": "documents", "sources": {
        "raw": {"kind": "csv", "path": raw, "schema": "DOCUMENTS"},
        "report": {"kind": "csv", "path": report, "schema": "DOCUMENT_REPORT", "encoding": "ISO-8859-1"}},
        "params": {"year": 2023, "month": 11, "reviewer_ids": [50]}, "output": {"path": str(out)}})
    assert [(r["documents"], r["reviewed"], r["in_time"], r["pct"]) for r in read_csv(spark, out / "reviewers")] == [("2", "1", "1", "100.0")]
    assert [r["doc_id"] for r in read_csv(spark, out / "unreviewed")] == ["2"]
    assert {r["metric"]: r["value"] for r in read_csv(spark, out / "metrics")} == {"rows": "5.0", "bad_dates": "1.0"}
    assert {r["report_patient_name"] for r in read_csv(spark, out / "review_lags")} == {"Ñu", None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_malformed_rows_are_reported(spark, tmp_path):
    path = tmp_path / "docs.csv"
    header = ",".join(schemas.DOCUMENT_COLUMNS)
    good = {"docID": "1", "ReviewerId": "50", "reviewername": "R", "Review": "1", "delFlag": "0", "scanDate": "Nov  1 2023  9:00AM"}
    line = ",".join(good.get(c, "") for c in schemas.DOCUMENT_COLUMNS)
    path.write_text(f"{header}\n{line}\n{line},extra\nshort\n")
    report = write_csv(tmp_path / "report.csv", schemas.REPORT_COLUMNS, [])
    jobs.run(spark, {"job": "documents", "sources": {"raw": {"kind": "csv", "path": str(path), "schema": "DOCUMENTS"},
                                                     "report": {"kind": "csv", "path": report, "schema": "DOCUMENT_REPORT"}},
                     "params": {"year": 2023, "month": 11, "reviewer_ids": [50]}, "output": {"path": str(tmp_path / "out")}})
    found = {(r["stage"], r["metric"]): r["value"] for r in read_csv(spark, tmp_path / "out/source_metrics")}
    assert found == {("raw", "rows"): "3.0", ("raw", "malformed_rows"): "2.0", ("report", "rows"): "0.0", ("report", "malformed_rows"): "0.0"}


@pytest.fixture(scope="module")
def day():
    from datetime import date, datetime

    return lambda m, d, hour=None: date(2023, m, d) if hour is None else datetime(2023, m, d, hour)


def test_snapshot(spark, day, tmp_path):
    visits = [(1, 100, day(1, 2), 10, 1, 5, 0, "x", "t"), (2, 101, day(1, 3), 11, 1, 5, 0, "x", "t"), (3, 102, day(2, 1), 10, 1, 5, 0, "x", "t")]
    claims = [(1, 1, 9, 10, 1, 1, day(1, 1), 1, 1, 0, None, "hi"), (2, 1, 4, 10, 1, 1, day(1, 5), 1, 1, 0, None, "hi")]
    spark.sql("CREATE DATABASE IF NOT EXISTS snap")
    jobs.run(spark, {"job": "snapshot", "sources": {
        "visits": table(spark, "s_visits", schemas.VISITS, visits), "claims": table(spark, "s_claims", schemas.CLAIMS, claims),
        "facility_group": table(spark, "s_fac", schemas.FACILITY_GROUP, [(10, "A"), (11, "B")]),
        "primary_insurance": table(spark, "s_ins", schemas.PRIMARY_INSURANCE, [(9, "Medicaid", "g", "n"), (4, "Private", "g", "n")])},
        "params": {"start": "2023-01-01", "end": "2023-01-10", "sites": ["A"]}, "output": {"database": "snap"}})
    users = {r.patient_id: r for r in spark.table("snap.users").collect()}
    assert set(users) == {1, 2} and users[1].max_insurance_id == 9 and users[1].latest_insurance_class == "Private"
    assert [r.patient_id for r in spark.table("snap.site_users").collect()] == [1]
    assert {t.name for t in spark.catalog.listTables("snap")} == {"visits", "users", "site_users"}


def test_fiscal(spark, day):
    calendar = [(day(7, 1), "FY23 - 7"), (day(8, 1), "FY23 - 8")]
    tables = jobs.fiscal_job(
        spark.createDataFrame([(1, 100, day(7, 1), 10, 1, 5, 0, "CHK : check out", "t"), (1, 101, day(7, 1), 10, 1, 5, 0, "open", "t")], schemas.VISITS),
        spark.createDataFrame([(1, 11, 10.5, day(7, 1), day(8, 1)), (2, 12, 1.0, day(8, 1), None)], "claim_no long, encounter_id long, payment double, service_date date, deposit_date date"),
        spark.createDataFrame([(1, 11, 5, "Ann", "X", "high", day(7, 1)), (1, 11, 5, "Ann", "X", "high", day(7, 1)), (2, 13, 6, "Bob", "Y", "low", day(8, 1))], schemas.CLAIMS_WITH_CPT),
        spark.createDataFrame([(1, 11, 5, "Ann", "high", "new", day(7, 1), None, None), (2, 12, 6, "Bob", "low", "old", day(8, 1), None, None)], schemas.CLAIMS_WITHOUT_CPT),
        spark.createDataFrame(calendar, schemas.FISCAL_CALENDAR),
        periods=["FY23 - 7", "FY23 - 8"], claim_order=["encounter_id"])
    pay = {(r.resource_provider_name, r.period): r.total_payment for r in tables["revenue_by_payer"].collect()}
    assert pay == {("Ann", "FY23 - 7"): 10.5, ("Bob", "FY23 - 8"): 1.0}
    assert [(r.resource_provider_name, r.period, r.total_payment) for r in tables["collections_by_visit_type"].collect()] == [("Ann", "FY23 - 8", 10.5)]
    assert [r.claims for r in tables["claims_by_quality"].collect()] == [1, 1]
    assert [r.period for r in tables["checked_out_visits"].collect()] == ["FY23 - 7"]
    assert sorted(map(tuple, tables["key_pairs"].collect())) == [(11, 11), (12, 13)]
    assert len(tables) == 11


def test_scorecard(spark, day):
    claims = [(1, 1, 9, 10, 1, 1, day(1, 1), 7, 1, 1, None, "hi"), (2, 1, 9, 11, 1, 1, day(1, 1), 7, 1, 0, None, "hi")]
    tables = jobs.scorecard_job(
        spark.createDataFrame(claims, schemas.CLAIMS),
        spark.createDataFrame([c + (3, 2) for c in claims], schemas.PROCEDURES),
        spark.createDataFrame([(7, "P1", "W1", "Y23")], schemas.CALENDAR_WEEK),
        spark.createDataFrame([(10, "001 A"), (11, "900 H")], schemas.FACILITY_GROUP),
        spark.createDataFrame([(9, "Medicaid", "g", "n")], schemas.PRIMARY_INSURANCE),
        spark.createDataFrame([(1, "Ann"), (2, "Bob")], schemas.RESOURCE_PROVIDER),
        spark.createDataFrame([(1, "new", "d")], schemas.VISIT_TYPE),
        spark.createDataFrame([(3, "Surgery", "Cut")], schemas.CPT), year="Y23", clinic_prefix="00", excluded=["Dummy"])
    got = [(r.provider, r.location, r.visits, r.visit_type, r.new_patients) for r in tables["scorecard"].collect()]
    assert got == [("Ann", "CLINIC", 1, "new", 1), ("Bob", "HOSPITAL", 1, "Surgery", 0)]


def test_funnel(spark, day, tmp_path):
    def entry(site, reason, notes="DOB: 01/02/1990"):
        return json.dumps({"FacilityName": {"OldValue": "", "NewValue": site}, "Reason": {"NewValue": reason}, "Notes": {"NewValue": notes},
                           "VisitStatus": {"NewValue": "done"}})

    log = [(1, 10, day(1, 5), day(1, 1, 9), entry("A", "pain")), (1, 11, day(1, 9), day(1, 2, 9), entry("A", "check")),
           (2, 12, day(1, 6), day(1, 1, 9), entry("A", "pain")), (3, 13, day(1, 6), day(1, 1, 9), entry("Z", "pain")), (4, 14, day(1, 6), day(1, 1, 9), "bad")]
    done = "CHK : Check Out"
    encounters = [(10, "open", "Ann", day(1, 5)), (11, done, "Ann", day(1, 9)), (12, done, "Bob", day(1, 6)), (13, done, "Bob", day(1, 6))]
    visits = [(1, 11, day(1, 9), 1, 1, 5, 1, done, "new"), (1, 15, day(1, 1), 1, 1, 5, 1, done, "early"), (2, 12, day(1, 6), 1, 1, 5, 0, done, "old"), (3, 13, day(1, 6), 1, 1, 5, 1, done, "new")]
    claims = [(100, 11, 1, "Ann", "X", "hi", day(1, 9)), (100, 11, 1, "Ann", "X", "hi", day(1, 9)), (101, 12, 2, "Bob", "X", "hi", day(1, 6))]
    from decimal import Decimal

    charges = [(100, 11, 1, "Ann", "hi", "new", day(1, 9), Decimal("5.50"), Decimal("7")), (101, 12, 2, "Bob", "hi", "new", day(1, 6), Decimal("1.25"), Decimal("7"))]
    invoices = write_csv(tmp_path / "inv.csv", schemas.INVOICE_COLUMNS, [
        {"PatientDateOfBirth": "1/2/1990", "AppointmentTime": "1/9/2023 3:00 pm", "BookingTime": "1/2/2023 9:00 AM", "PatientEmail": "a@x", "PatientFirstName": "Ann", "PatientLastName": "Lee", "Premium": "Yes"},
        {"BookingTime": "oops", "PatientEmail": "b@x", "Premium": "Yes"}, {"BookingTime": "02/20/2024", "PatientEmail": "c@x", "Premium": "Yes"}])
    spark.sql("CREATE DATABASE IF NOT EXISTS fun")
    tables = jobs.run(spark, {"job": "funnel", "sources": {
        "log": table(spark, "f_log", schemas.BOOKING_LOG, log), "invoices": {"kind": "csv", "path": invoices, "schema": "BOOKING_INVOICES"},
        "encounters": table(spark, "f_enc", schemas.ENCOUNTERS, encounters), "visits": table(spark, "f_vis", schemas.VISITS, visits),
        "claims_with": table(spark, "f_cw", schemas.CLAIMS_WITH_CPT, claims), "claims_without": table(spark, "f_cwo", schemas.CLAIMS_WITHOUT_CPT, charges)},
        "params": {"sites": ["A"], "cutoff": "12/01/2023"}, "output": {"database": "fun"}})
    got = {name: spark.table(f"fun.{name}") for name in tables}
    assert {r.patient_id: r.converted_rn for r in got["conversions"].collect()} == {1: 2, 2: 1}
    assert {r.patient_id: r.validator for r in got["validator"].collect()} == {1: 1, 2: 0}
    totals = got["billing_totals"].first()
    assert (totals.total_payment, totals.new_payment, totals.established_payment) == (6.75, 5.5, 1.25)
    assert {r.Reason: (r.booked, r.new_patients) for r in got["reasons"].collect()} == {"check": (1, 1), "pain": (1, 0)}
    assert [(r.PatientEmail, r.names, r.week) for r in got["billed_users"].collect()] == [("a@x", "Ann Lee", "S1")]
    assert got["new_billing"].count() == 1 and got["established_visits"].count() == 1
    metrics = {(r.stage, r.metric): r.value for r in got["metrics"].collect()}
    assert metrics == {
        ("log_entries", "rows"): 3, ("log_summary", "patients"): 2, ("log_encounters", "rows"): 3, ("conversions", "rows"): 2, ("converted", "patients"): 2,
        ("visits_since_first", "rows"): 2, ("validator", "patients"): 2, ("billing", "rows"): 2, ("new_entries", "new_patients"): 1,
        ("last_entries", "booked"): 2, ("reasons", "booked"): 2, ("reasons", "new_patients"): 1, ("invoices", "bad_dates"): 1, ("billed", "rows"): 1,
        ("billed_users", "rows"): 1}
    assert {r.encounter_id: r.dob for r in got["log"].collect()} == dict.fromkeys((10, 11, 12), "01/02/1990")
    assert [(r.PatientDateOfBirth, r.AppointmentTime) for r in got["invoices"].collect()] == [("01/02/1990", "01/09/2023")]
    assert {"log_entries", "billed_entries", "converted_entries", "converted_encounter_entries"} <= set(got)
    assert got["sequence"].where("dob = '01/02/1990'").count() == 3


def test_copy(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    jobs.run(spark, {"job": "copy", "sources": {"table": {"kind": "parquet", "path": str(tmp_path / "in")}},
                     "output": {"path": str(tmp_path / "out"), "kind": "parquet"}})
    assert spark.read.parquet(str(tmp_path / "out/copy")).count() == 7
