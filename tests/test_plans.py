"""The reports on small invented rows, with results worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caretally.operators import aggs
from caretally.operators.sequence import masked_conversions, ordinal_mix, visit_sequence
from caretally.plans import documents, fiscal, funnel, labs, scorecard, snapshot


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    found = df.collect()
    assert len(found) == 1, found
    return found[0].asDict()


# --- snapshot ----------------------------------------------------------------


@pytest.fixture(scope="module")
def clinic(spark):
    d = date
    visits = spark.createDataFrame(
        [(1, 100, d(2024, 1, 2), 5, 1, 10), (1, 101, d(2024, 1, 9), 3, 0, 11), (2, 102, d(2024, 1, 10), 5, 0, 10),
         (3, 103, d(2024, 1, 3), 5, 0, 99), (None, 104, d(2024, 1, 4), 1, 0, 10)],
        "patient_id int, encounter_id int, appointment_date date, general_visit_status_id int, is_new_patient int, facility_group_id int")
    sites = spark.createDataFrame([(10, "A"), (11, "B")], "facility_group_id int, facility_group_name string")
    claims = spark.createDataFrame(
        [(1, 1, d(2023, 1, 1), 9), (1, 2, d(2023, 5, 1), 4), (1, 3, d(2023, 4, 1), None), (2, 4, d(2023, 1, 1), 9)],
        "patient_id int, claim_no int, service_date date, primary_insurance_id int")
    plans = spark.createDataFrame([(9, "Medicaid"), (4, "Private")], "primary_insurance_id int, primary_insurance_class string")
    return snapshot.visits_in_window(visits, sites, d(2024, 1, 1), d(2024, 1, 10)), snapshot.claims_with_insurance(claims, plans), visits, sites, plans


def test_window_keeps_all_statuses_unless_told(clinic):
    window, _, visits, sites, _ = clinic
    assert sorted(r.encounter_id for r in window.collect()) == [100, 101, 103, 104]
    only = snapshot.visits_in_window(visits, sites, date(2024, 1, 1), date(2024, 1, 10), statuses=[5])
    assert sorted(r.encounter_id for r in only.collect()) == [100, 103]


def test_fanout_fills_insurance(clinic):
    window, claims, *_ = clinic
    rows = snapshot.visit_claims(window, claims).collect()
    assert len(rows) == 8
    assert {r.primary_insurance_id for r in rows if r.patient_id in (3, None)} == {0}


def test_snapshot_max_is_not_latest(clinic):
    window, claims, _, _, plans = clinic
    snap = snapshot.patient_snapshot(window, claims.drop("primary_insurance_class"), plans)
    first = one(snap, patient_id=1)
    assert (first["facility_group_name"], first["appointment_date"]) == ("B", date(2024, 1, 9))
    assert (first["max_insurance_id"], first["max_insurance_class"]) == (9, "Private")
    assert (first["latest_insurance_id"], first["latest_insurance_class"]) == (4, "Private")
    assert one(snap, patient_id=3)["max_insurance_id"] == 0 and one(snap, patient_id=3)["facility_group_name"] is None
    assert one(snap, patient_id=None)["max_insurance_class"] is None
    assert snapshot.site_report(snap, ["B", "Z"]).count() == 1
    assert "SortAggregate" not in snap._jdf.queryExecution().executedPlan().toString()
    assert [r.facility_group_name for r in snapshot.in_report_order(snap).collect()] == [None, "A", "B"]


# --- fiscal ------------------------------------------------------------------


@pytest.fixture(scope="module")
def books(spark):
    d = date
    calendar = spark.createDataFrame([(d(2023, 7, 1), "FY23 - 7"), (d(2023, 8, 1), "FY23 - 8")], "dates date, period string")
    lines = spark.createDataFrame(
        [(1, 11, d(2023, 7, 1), d(2023, 8, 1), 10.1), (1, 11, d(2023, 7, 1), d(2023, 8, 1), 0.2), (2, 12, d(2023, 8, 1), d(2023, 8, 1), 5.0),
         (9, 19, d(2023, 7, 1), d(2023, 7, 1), 1.0), (None, 20, d(2023, 7, 1), d(2023, 7, 1), 2.0), (2, 12, d(2022, 1, 1), None, 7.0),
         (2, 12, d(2023, 8, 1), None, None)],
        "claim_no int, encounter_id int, service_date date, deposit_date date, payment double")
    claims = spark.createDataFrame(
        [(1, 11, "Ann", "X", d(2023, 7, 1)), (1, 99, "Ann", "X", d(2023, 7, 1)), (2, 12, "Bob", "Y", d(2023, 8, 1)), (3, 13, "Bob", "Y", d(2022, 1, 1))],
        "claim_no int, encounter_id int, resource_provider_name string, payer_class string, service_date date")
    return calendar, lines, claims


def test_money_counts_repeats_and_keeps_unmatched(books):
    calendar, lines, claims = books
    periods = ["FY23 - 7", "FY23 - 8"]
    rev = fiscal.within_periods(lines, "service_date", calendar, periods)
    fan = fiscal.money_report(rev, claims, "payer_class")
    assert one(fan, resource_provider_name="Ann")["total_payment"] == 20.6
    single = fiscal.one_per_claim(claims, ["encounter_id"])
    got = fiscal.money_report(rev, single, "payer_class")
    assert one(got, resource_provider_name="Ann")["total_payment"] == 10.3
    assert one(got, resource_provider_name="Bob")["total_payment"] == 5.0
    assert one(got, resource_provider_name=None) == {"period": "FY23 - 7", "resource_provider_name": None, "payer_class": None, "total_payment": 3.0}
    total = got.agg(F.sum("total_payment")).first()[0]
    assert total == rev.agg(F.sum(aggs.money("payment")).cast("double")).first()[0]


def test_collections_use_the_deposit_date(books):
    calendar, lines, claims = books
    col = fiscal.within_periods(lines, "deposit_date", calendar, ["FY23 - 8"])
    got = fiscal.money_report(col, fiscal.one_per_claim(claims, ["encounter_id"]), "payer_class")
    assert one(got, resource_provider_name="Ann")["total_payment"] == 10.3
    assert fiscal.in_report_order(got).first()["resource_provider_name"] == "Ann"


def test_claim_counts_and_uniqueness(books):
    calendar, _, claims = books
    counts = fiscal.claim_counts(fiscal.with_period(claims, "service_date", calendar), "payer_class")
    assert one(counts, resource_provider_name="Ann")["claims"] == 1
    assert one(counts, resource_provider_name="Bob", period=None)["claims"] == 1
    with pytest.raises(ValueError):
        aggs.assert_unique(claims, ["claim_no"])
    assert aggs.assert_unique(claims, ["claim_no", "encounter_id"]).count() == 4


def test_within_periods_is_both_steps(books, as_rows):
    calendar, lines, _ = books
    for periods in (["FY23 - 7"], ["FY23 - 7", "FY23 - 8"], ["FY99 - 1"]):
        two = fiscal.in_periods(fiscal.with_period(lines, "service_date", calendar), periods)
        assert as_rows(fiscal.within_periods(lines, "service_date", calendar, periods)) == as_rows(two)


def test_periods_are_found_when_the_query_runs(books, spark, tmp_path):
    """No job while the plan is built; the scan gets the bounds, and staged periods are read from their folders."""
    calendar, lines, _ = books
    for name, df in (("lines", lines), ("calendar", calendar)):
        df.write.parquet(str(tmp_path / name))
    calendar, lines = (spark.read.parquet(str(tmp_path / n)) for n in ("calendar", "lines"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    kept = fiscal.within_periods(lines, "service_date", calendar, ["FY23 - 8"])
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("other", "other")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("scalar-subquery") + plan.count("Subquery") >= 2
    assert kept.count() == 2
    staged = fiscal.by_month(lines, "service_date", calendar)
    found = fiscal.of_periods(staged, calendar.where("dates >= '2023-08-01'"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and {r.period for r in found.collect()} == {"FY23 - 8"} and staged.count() == 6


def test_key_pairs(books):
    _, lines, claims = books
    pairs = fiscal.key_pairs(lines, fiscal.one_per_claim(claims, ["encounter_id"])).collect()
    assert sorted((r[0], r[1] or 0) for r in pairs) == [(11, 11), (11, 11), (12, 12), (12, 12), (12, 12), (19, 0), (20, 0)]


def test_all_null_payments_sum_to_zero(spark):
    lines = spark.createDataFrame([(1, "p", None)], "claim_no int, period string, payment double")
    claims = spark.createDataFrame([(1, "Ann", "X")], "claim_no int, resource_provider_name string, payer_class string")
    assert fiscal.money_report(lines, claims, "payer_class").first()["total_payment"] == 0.0


# --- scorecard ---------------------------------------------------------------


def test_scorecard(spark):
    star = spark.createDataFrame(
        [("Ann", "001 A", 1, "Y23", "P1", "W1", "hi", "X", "new", 2.4, 1, "Exam", "Office"), ("Ann", "001 A", 1, "Y23", "P1", "W1", "hi", "X", "new", 0.1, 0, "Exam", "Office"),
         ("Ann", "001 A", 0, "Y23", "P1", "W1", "hi", "X", "new", 9.0, 1, "Exam", "Office"), ("Ann", "001 A", 1, "Y22", "P1", "W1", "hi", "X", "new", 9.0, 1, "Exam", "Office"),
         ("Ann", "001 A", 1, "Y23", "P1", "W1", "hi", None, "new", 9.0, 1, "Exam", "Office"), ("Bob", "900 H", 1, "Y23", "P2", "W9", "lo", None, "old", 4.0, 0, "Surgery", "Cut"),
         ("Bob", "900 H", 1, "Y23", "P2", "W9", "lo", None, "old", 4.0, 0, "Surgery", "a dummy code"), (None, "900 H", 1, "Y23", "P2", "W9", "lo", None, "old", 4.0, 0, "Surgery", "Cut"),
         ("Bob", None, 1, "Y23", "P2", "W9", "lo", None, "old", 4.0, 0, "Surgery", "Cut"), ("Bob", "900 H", 1, "Y23", "P2", "W9", "lo", None, "old", 4.0, 0, "Surgery", None)],
        "resource_provider_name string, facility_group_name string, is_billable int, calendar_year string, calendar_period string, "
        "calendar_week string, complexity_level string, primary_insurance_class string, visit_type string, payment double, new_patient int, cpt_group string, cpt_description string")
    clinic = scorecard.scorecard(scorecard.clinic_rows(star, "Y23", "00"), "visit_type", "CLINIC")
    assert one(clinic)["visits"] == 2 and one(clinic)["revenue"] == 3.0 and one(clinic)["new_patients"] == 1
    hospital = scorecard.scorecard(scorecard.hospital_rows(star, "00", ["Dummy"]), "cpt_group", "HOSPITAL")
    assert one(hospital, provider="Bob")["visits"] == 1 and one(hospital, provider="Bob")["visit_type"] == "Surgery"
    both = scorecard.in_report_order(scorecard.stacked(clinic, hospital)).collect()
    assert [r.provider for r in both] == ["Ann", "Bob", None] and both[0].location == "CLINIC"


# --- documents ---------------------------------------------------------------


def test_documents(spark):
    names = "docID PatientId ReviewerId reviewername ScannedBy customName fileformat filename Review delFlag scanDate".split()
    raw = spark.createDataFrame(
        [("1", "7", "50", "Ann", "s", "c", "pdf", "f", "1", "0", "Nov  1 2023  9:05AM"), ("1", "7", "50", "Ann", "s", "c", "pdf", "f", "1", "0", "Nov  2 2023  9:05AM"),
         ("2", "7", "50", "Ann", "s", "c", "pdf", "f", "1", "0", "Nov 10 2023 11:05PM"), ("3", "7", "50", "Ann", "s", "c", "pdf", "f", "0", "0", "Nov 10 2023 11:05PM"),
         ("4", "7", "51", "Bob", "s", "c", "pdf", "f", "0", "0", "Nov 10 2023 11:05PM"), ("5", "7", "51", "Bob", "s", "c", "pdf", "f", "0", "1", "Nov 10 2023 11:05PM"),
         ("6", "7", "52", "Eve", "s", "c", "pdf", "f", "0", "0", "Nov 10 2023 11:05PM"), ("7", "7", "51", "Bob", "s", "c", "pdf", "f", "0", "0", "Dec 10 2023 11:05PM"),
         ("8", "7", "51", "Bob", "s", "c", "pdf", "f", "0", "0", "not a date")], names)
    report = spark.createDataFrame(
        [("1", "02/11/2023", "s", "Ann", "7:Kim:Lee"), ("1", "20/11/2023", "s", "Ann", "7:Kim"), ("2", "20/11/2023", "s", "Ann", "7"),
         ("3", "11/11/2023", "s", "Ann", None), ("99", "11/11/2023", "s", "Ann", "1:x")],
        ["Document ID", "Reviewed Date", "Scanned By", "Reviewer Name", "Patient Acct No + Name"])
    month = documents.month_of_documents(documents.typed_documents(raw), 2023, 11)
    assert month.count() == 7
    assigned = documents.assigned_documents(month, [50, 51], ["scan_date"])
    assert sorted(r.doc_id for r in assigned.collect()) == [1, 2, 3, 4]
    lags = documents.review_lags(assigned, documents.typed_report(report), ["reviewed_date"])
    assert sorted((r.doc_id, r.review_days, r.in_time) for r in lags.collect()) == [(1, 1, 1), (2, 10, 0), (3, 1, 1), (4, None, 0)]
    assert one(lags, doc_id=1)["report_patient_name"] == "Kim:Lee"
    sla = documents.reviewer_sla(lags)
    ann = one(sla, reviewer_id=50)
    # Three documents, two reviewed; document 3 is dated but not reviewed.
    assert (ann["documents"], ann["reviewed"], ann["unreviewed"], ann["in_time"], ann["pct_compat"], ann["pct"]) == (3, 2, 1, 2, 100, 50.0)
    bob = one(sla, reviewer_id=51)
    assert (bob["reviewed"], bob["pct_compat"], bob["pct"]) == (0, None, None)
    assert sorted(r.doc_id for r in documents.unreviewed(assigned).collect()) == [3, 4]
    assert documents.in_report_order(sla).count() == 2


# --- labs --------------------------------------------------------------------

NEVER = "Jan  1 1901 12:00AM"


@pytest.fixture(scope="module")
def lab_rows(spark):
    names = "EncounterId ItemId ReviewedBy assignedToId ordPhyId ordPhyName collDate ResultDate ReviewedDate".split()
    rows = [
        ("1", "5", "50", "60", "70", "Kim", "Nov  1 2023  9:00AM", "Nov  1 2023 11:00AM", "Nov  2 2023 12:00PM"),  # 1 day
        ("1", "6", "50", "61", "70", "Kim", "Nov  1 2023  9:00AM", "Nov  3 2023 11:00AM", "Nov  7 2023 11:00AM"),  # 4 days
        ("2", "5", "0", "60", "71", "Lee", "Nov  1 2023  9:00AM", "Nov  1 2023 11:00AM", NEVER),
        ("2", "5", "50", "60", "71", None, None, "Nov  1 2023 11:00AM", "Nov  1 2023  9:00AM"),  # -1 day, no collection
        ("3", "6", None, "60", "70", "Kim", "Nov  1 2023  9:00AM", "Nov 20 2023 11:00AM", "Dec 25 2023 11:00AM"),  # 35 days
        ("4", "6", "51", None, "70", "Kim", "Nov  1 2023  9:00AM", "Dec  1 2023 11:00AM", "Dec  1 2023 11:00AM"),  # other month
        ("5", "6", "51", "60", "70", "Kim", "Nov  1 2023  9:00AM", NEVER, NEVER),
    ]
    typed = labs.typed_labs(spark.createDataFrame(rows, names))
    return typed, labs.with_lags(labs.month_of_results(typed, 2023, 11), [5])


def test_lab_splits(lab_rows):
    typed, frame = lab_rows
    assert frame.count() == 5
    cells = {(r.answered_compat, r.in_house): (r.labs, r.encounters) for r in labs.outcome_counts(frame).collect()}
    assert cells == {(True, True): (2, 2), (True, False): (2, 2), (False, True): (1, 1)}
    assert frame.where("answered").count() == 5
    whole = labs.with_lags(typed, [5], datetime(2024, 1, 1))
    never = one(whole, encounter_id=5)
    # A result that never came is no missing collection date.
    assert (never["answered"], never["answered_compat"], never["result_days"]) == (False, True, None)
    assert never["run_time"] == datetime(2024, 1, 1)


def test_same_day_and_complement(lab_rows):
    _, frame = lab_rows
    same, other = labs.same_day_reviewed(frame), labs.not_same_day_reviewed(frame)
    assert same.count() == 1 and same.count() + other.count() == frame.count()


def test_reviewer_buckets(lab_rows):
    _, frame = lab_rows
    got = labs.reviewer_buckets(frame.where("answered"))
    ann = one(got, reviewed_by="50")
    assert (ann["labs"], ann["b1"], ann["b2"], ann["b3"], ann["b4"], ann["b5"]) == (3, 2, 1, None, None, None)
    assert (ann["share_b1"], ann["share_b2"], ann["share_le_5"], ann["avg_rev"]) == (0.67, 0.33, 1.0, 1.33)
    assert (ann["assigned_to"], ann["ordered_by"], ann["orderer_names"]) == ("60,61", "70//,71//", "Kim//")
    nobody = one(got, reviewed_by=None)
    assert (nobody["labs"], nobody["b5"], nobody["share_b2"]) == (1, None, None)
    zero = one(got, reviewed_by="0")
    assert (zero["labs"], zero["avg_rev"], zero["b1"]) == (1, None, None)
    assert labs.in_report_order(got).first()["reviewed_by"] == "50"
    detail = labs.bucket_detail(frame.where("answered"))
    assert one(detail, reviewed_by=None)["bucket"] == 5 and one(detail, reviewed_by="50", bucket=2)["avg_rev"] == 4.0
    histogram = {r.review_days: r.labs for r in labs.lag_histogram(frame).collect()}
    assert histogram == {1: 1, 4: 1, None: 1, -1: 1, 35: 1}


def test_queues_and_encounters(lab_rows):
    _, frame = lab_rows
    queue = labs.pending_queue(labs.answered_unreviewed(frame))
    assert one(queue) == {"assigned_to_id": "60", "ordered_by": "71", "avg_rev": None, "labs": 1}
    second = one(labs.encounter_summary(frame), encounter_id=2)
    assert (second["labs"], second["avg_rev"], second["pending"]) == (2, -1.0, 1)
    assert one(labs.encounter_counts(frame), encounter_id=1)["labs"] == 2


# --- funnel ------------------------------------------------------------------


def test_log(spark):
    log = spark.createDataFrame(
        [(1, 10, datetime(2023, 1, 1), '{"FacilityName":{"NewValue":"A"},"Reason":{"NewValue":"pain"},"VisitStatus":{"NewValue":"new"},"Notes":{"NewValue":"DOB: 01/02/1990"}}'),
         (1, 11, datetime(2023, 1, 2), '{"FacilityName":{"NewValue":"B"},"Reason":{"NewValue":null},"VisitStatus":{"NewValue":"done"}}'),
         (1, 12, datetime(2023, 1, 2), '{"FacilityName":{"NewValue":"A"},"Reason":{"NewValue":"check"},"VisitStatus":{"NewValue":"done"}}'),
         (2, 13, datetime(2023, 1, 2), '{"FacilityName":{"NewValue":"C"}}'), (3, 14, datetime(2023, 1, 2), 'oops')],
        "patient_id int, encounter_id int, modify_date timestamp_ntz, log_details string")
    rows = funnel.site_log(funnel.log_with_fields(log), ["A", "B"])
    assert sorted((r.encounter_id, r.dob) for r in rows.collect()) == [(10, "01/02/1990"), (11, None), (12, None)]
    assert one(funnel.last_entries(rows))["encounter_id"] == 12
    summary = one(funnel.log_summary(funnel.log_entries(rows)))
    assert (summary["billed_times"], summary["reasons"], summary["visit_statuses"]) == (3, "pain// ,check// ", "new// ,done// ,done// ")


def test_invoices(spark):
    raw = spark.createDataFrame(
        [(1, "1/5/2023 3:04 pm", "a@x", "Ann", "Lee", "Yes"), (2, "12/01/2023", "a@x", "Anna", "Lee", "Yes"), (3, "01/15/2024", "b@x", "Bob", None, "Yes"),
         (4, "11/30/2023 23:00", "c@x", "Cy", "Z", "No"), (5, "nonsense", "d@x", "D", "D", "Yes"), (6, "12/24/2023", None, "E", "E", "Yes")],
        "id int, BookingTime string, PatientEmail string, PatientFirstName string, PatientLastName string, Premium string")
    raw = raw.withColumns({"PatientDateOfBirth": F.lit("13/45/2023"), "AppointmentTime": F.col("BookingTime")})
    invoices = funnel.standard_invoices(raw)
    assert one(invoices, id=5)["BookingTime"] is None and one(invoices, id=1)["PatientDateOfBirth"] is None
    assert sorted(r.id for r in funnel.invoices_until(invoices, "12/01/2023").collect()) == [1, 2, 4]
    assert sorted(r.id for r in funnel.invoices_until(invoices, "12/01/2023", "text").collect()) == [1, 2, 3, 4]
    kept = funnel.invoices_until(invoices, "12/31/2024")
    assert (one(kept, id=1)["day"], one(kept, id=1)["month"], one(kept, id=1)["week"]) == (5, 1, "S1")
    users = funnel.billed_users(funnel.billed_entries(kept, ["id"], show=["id", "week"]), show=["id", "week"])
    ann = one(users, PatientEmail="a@x")
    assert (ann["id"], ann["names"], ann["n"]) == (1, "Ann Lee,Anna Lee", 2)
    assert one(users, PatientEmail="b@x")["names"] is None
    assert one(users, PatientEmail=None)["names"] == "E E"
    assert {r.week: r.times for r in funnel.users_by_week(users).collect()} == {"S1": 1, "S2": 1, "S4": 1}


@pytest.fixture(scope="module")
def journeys(spark):
    """1: converts first; 2: fifth; 3: never; 4: two birth dates, one each."""
    rows, n = [], 0
    for patient, dob, statuses in [(1, "a", "CnC"), (2, "a", "nnnnC"), (3, "a", "nn"), (4, "a", "nC"), (4, "b", "C"), (5, None, "nnC")]:
        for i, s in enumerate(statuses):
            n += 1
            rows.append((patient, dob, n, date(2023, 1, 1 + i), funnel.CHECKED_OUT if s == "C" else "no show"))
    return spark.createDataFrame(rows, "patient_id int, dob string, encounter_id int, appointment_date date, visit_status string").withColumn(
        "matched_encounter_id", F.col("encounter_id"))


@pytest.mark.parametrize("group_rows", [2, 100_000])
def test_sequence(journeys, group_rows):
    seq = funnel.sequence(journeys, group_rows=group_rows)
    last = one(seq, patient_id=1, rn=3)
    assert (last["converted_rn"], last["conversions_so_far"], last["is_converted"]) == (3, 2, 1)
    assert one(seq, patient_id=1, rn=2)["converted_rn"] is None
    masked = funnel.conversions(seq, group_rows=group_rows)
    assert "is_converted" not in masked.columns and masked.count() == 6
    got = {(r.patient_id, r.encounter_id): (r.converted_rn, r.conversions_so_far) for r in masked.collect()}
    # Numbered per birth date, masked per patient: patient 4's first is day 1 of "b".
    assert got == {(1, 1): (1, None), (1, 3): (None, 2), (2, 8): (5, 1), (4, 12): (None, 1), (4, 13): (1, None), (5, 16): (3, 1)}
    mix = one(ordinal_mix(masked))
    assert (mix["ord_1"], mix["ord_2"], mix["ord_3"], mix["later"], mix["ord_5_plus"]) == (2, 0, 1, 1, 1)
    assert (mix["first_visit_users"], mix["mean_ordinal"]) == (2, 2.5)
    assert funnel.one_per_patient(masked).count() == 4
    assert one(funnel.converted_encounters(funnel.converted_encounter_entries(masked)), patient_id=1)["encounter_ids"] == "1,3"


def test_masked_keys_may_differ(journeys):
    seq = visit_sequence(journeys, ["patient_id"], ["appointment_date", "encounter_id"], F.col("visit_status") == funnel.CHECKED_OUT)
    masked = masked_conversions(seq, ["patient_id", "dob"], ["appointment_date", "encounter_id"])
    assert masked.where("converted_rn is not null").count() == 5


def test_log_encounters(spark):
    log = spark.createDataFrame([(1, 10, date(2023, 1, 1)), (1, 11, date(2023, 1, 2)), (1, None, date(2023, 1, 3)), (2, 12, date(2023, 1, 1))],
                                "patient_id int, encounter_id int, appointment_date date")
    enc = spark.createDataFrame([(10, funnel.CHECKED_OUT, date(2023, 2, 1), "Ann"), (11, funnel.CHECKED_OUT, date(2023, 2, 2), "Ann")],
                                "encounter_id int, visit_status string, appointment_date date, appointment_provider_name string")
    joined = funnel.log_encounters(log, enc)
    assert joined.count() == 4 and funnel.matched(joined).count() == 2
    user = one(funnel.converted_users(funnel.converted_entries(joined, show=["encounter_id"]), show=["encounter_id"]))
    assert (user["patient_id"], user["n"], user["patient_ids"], user["encounter_id"]) == (1, 2, "1,1", 10)


def test_cohorts_and_billing(spark):
    d = date
    log = spark.createDataFrame([(1, d(2023, 3, 1), 1), (1, d(2023, 2, 1), 2), (2, d(2023, 2, 1), 3), (3, d(2023, 2, 1), 4), (4, d(2023, 2, 1), 5)],
                                "patient_id int, appointment_date date, encounter_id int")
    users = funnel.with_first_seen(spark.createDataFrame([(1,), (2,), (3,)], "patient_id int"), log)
    visits = spark.createDataFrame(
        [(1, 10, d(2023, 2, 1), 1, "new"), (1, 11, d(2023, 3, 1), 0, "follow"), (1, 12, d(2023, 1, 1), 1, "old"), (2, 13, d(2023, 2, 2), 0, "follow"),
         (3, 14, d(2023, 2, 2), 1, "new"), (3, 15, d(2023, 2, 3), 1, None), (4, 16, d(2023, 2, 3), 1, "new")],
        "patient_id int, encounter_id int, appointment_date date, np_flag int, visit_type string").withColumn("visit_status", F.lit(funnel.CHECKED_OUT))
    since = funnel.visits_since_first(visits, users)
    assert sorted(r.encounter_id for r in since.collect()) == [10, 11, 13, 14, 15]
    val = funnel.cohort_validator(since)
    assert one(val, patient_id=1) == {"patient_id": 1, "validator": 1, "first_seen": d(2023, 2, 1), "visit_types": "follow,new"}
    assert [one(funnel.cohort(val, "new"))["patient_id"], one(funnel.cohort(val, "established"))["patient_id"]] == [1, 2]
    assert sorted(r.patient_id for r in funnel.cohort(val, "new", "nonzero").collect()) == [1, 3]
    new = funnel.cohort(val, "new")
    for hot_rows in (1, 100):
        starts = funnel.cohort_visits(since, new, hot_rows=hot_rows)
        assert "encounter_id" not in starts.columns
        assert [r.start_date for r in starts.collect()] == [d(2023, 2, 1)] * 2
    pairs = spark.createDataFrame([(100, 10), (101, 10), (102, 13), (102, 13), (103, 14)], "claim_no int, encounter_id int")
    charges = spark.createDataFrame([(100, d(2023, 2, 1), 1.1, 2.0), (101, d(2023, 1, 1), 50.0, 2.0), (102, d(2023, 2, 2), 2.2, 3.0), (103, d(2023, 2, 2), 4.4, 3.0)],
                                    "claim_no int, service_date date, payment double, billed_charge double")
    bill = funnel.billing_since_first(since, pairs, charges)
    assert sorted(r.claim_no for r in bill.collect()) == [100, 102, 103]
    assert [r.claim_no for r in funnel.cohort_billing(bill, new).collect()] == [100]
    totals = one(funnel.billing_totals(bill, val))
    assert totals == {"total_payment": 7.7, "new_payment": 1.1, "established_payment": 2.2}
    assert one(funnel.billing_totals(bill, val, "nonzero"))["new_payment"] == 5.5


def test_reason_share(spark):
    log = spark.createDataFrame(
        [(1, datetime(2023, 1, 1), 1, "pain"), (1, datetime(2023, 1, 2), 2, "check"), (2, datetime(2023, 1, 1), 3, "check"), (3, datetime(2023, 1, 1), 4, None), (4, datetime(2023, 1, 1), 5, "pain")],
        "patient_id int, modify_date timestamp_ntz, encounter_id int, Reason string")
    members = spark.createDataFrame([(1,), (3,), (9,)], "patient_id int")
    new_last = funnel.cohort_last_entries(members, log)
    assert one(new_last, patient_id=9)["Reason"] is None
    share = funnel.reason_share(funnel.last_entries(log), new_last)
    assert {r.Reason: (r.booked, r.new_patients) for r in share.collect()} == {"check": (2, 1), "pain": (1, 0), None: (0, 0)}
    assert funnel.reasons_in_order(share).first()["Reason"] == "check"
    assert share.agg(F.sum("booked")).first()[0] == funnel.last_entries(log).where("Reason is not null").count()


def test_run_metrics(spark, as_rows):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    got = aggs.run_metrics([("s", df, {"rows": F.count("*"), "users": F.countDistinct("a")}), ("t", df, {"bad": aggs.count_if(F.col("b").isNull())})])
    assert as_rows(got) == [("s", "rows", 2.0), ("s", "users", 1.0), ("t", "bad", 1.0)]
