"""Entries, summaries and sets, with keys of more entries than a cell takes."""

import pytest
from pyspark.sql import functions as F

from caretally.operators.ledger import Ledger
from caretally.operators.lists import distinct_entries, distinct_values, list_entries, list_pages, list_summary, set_summary, whole_summary
from caretally.plans import fiscal, funnel, labs
from caretally.session import stage

BIG = 25_000


@pytest.fixture(scope="module")
def visits(spark):
    """Patient 1 has 25,000 entries, patient 2 exactly 10,000, patient 3 three, null two; times are not in the order of the ids."""
    rows = [(1, k) for k in range(BIG)] + [(2, k) for k in range(10_000)] + [(3, k) for k in (2, 0, 1)] + [(None, 0), (None, 1)]
    frame = spark.createDataFrame(rows, "patient_id int, n int")
    return frame.withColumns({"when": F.lit(BIG) - F.col("n"), "reason": F.when(F.col("n") % 5 != 0, F.concat(F.lit("r"), F.col("n") % 13000))}).repartition(4)


@pytest.mark.parametrize("group_rows", [700, 10_000_000])
def test_one_row_per_key_at_every_size(visits, group_rows):
    entries = list_entries(visits, ["patient_id"], {"reasons": F.col("reason")}, ["when", "n"], first=["n"], group_rows=group_rows)
    assert entries.count() == visits.count()
    got = {r["patient_id"]: r.asDict() for r in list_summary(entries, ["patient_id"], ["reasons"], first=["n"], count="times").collect()}
    assert {k: (r["n"], r["times"]) for k, r in got.items()} == {1: (BIG - 1, BIG), 2: (9_999, 10_000), 3: (2, 3), None: (1, 2)}
    assert got[1]["reasons"] is None and got[3]["reasons"] == "r2,r1" and got[None]["reasons"] == "r1"
    assert got[2]["reasons"] == ",".join(f"r{k}" for k in range(9_999, -1, -1) if k % 5)
    pages = list_pages(entries.where("patient_id = 1"), ["patient_id"], ["reasons"]).orderBy("page").collect()
    assert [p["page"] for p in pages] == [0, 1, 2]
    assert ",".join(p["reasons"] for p in pages) == ",".join(f"r{k % 13000}" for k in range(BIG - 1, -1, -1) if k % 5)


@pytest.mark.parametrize("group_rows", [700, 10_000_000])
def test_whole_lists_of_any_length(visits, group_rows):
    entries = list_entries(visits, ["patient_id"], {"reasons": F.col("reason")}, ["when", "n"], first=["n"], group_rows=group_rows)
    for page_rows in (2, 10_000):
        got = {r["patient_id"]: tuple(r)[1:] for r in whole_summary(entries, ["patient_id"], ["reasons"], first=["n"], page_rows=page_rows).collect()}
        assert got == {1: (BIG - 1, BIG, ",".join(f"r{k % 13000}" for k in range(BIG - 1, -1, -1) if k % 5)),
                       2: (9_999, 10_000, ",".join(f"r{k}" for k in range(9_999, -1, -1) if k % 5)), 3: (2, 3, "r2,r1"), None: (1, 2, "r1")}
    odd = list_entries(visits, ["patient_id"], {"none": F.lit(None).cast("string"), "blank": F.lit("")}, ["when", "n"])
    assert {tuple(r)[2:] for r in whole_summary(odd, ["patient_id"], ["none", "blank"], page_rows=2).where("patient_id = 3").collect()} == {(None, ",,")}


def test_reports_show_whole_lists(spark):
    many = spark.range(10_001).select(F.lit(7).alias("patient_id"), F.col("id").alias("encounter_id"), F.col("id").alias("modify_date"), F.col("id").alias("appointment_date"),
                                      F.lit("pain").alias("Reason"), F.lit("done").alias("VisitStatus"), F.col("id").alias("matched_encounter_id"),
                                      F.lit(funnel.CHECKED_OUT).alias("visit_status"), F.lit("Yes").alias("Premium"), F.lit("a@x").alias("PatientEmail"),
                                      F.lit("Ann").alias("PatientFirstName"), F.col("id").cast("string").alias("PatientLastName"))
    log = funnel.log_summary(funnel.log_entries(many)).first()
    assert (log["billed_times"], log["reasons"], log["visit_statuses"]) == (10_001, ",".join(["pain// "] * 10_001), ",".join(["done// "] * 10_001))
    user = funnel.billed_users(funnel.billed_entries(many, ["encounter_id"])).first()
    assert (user["n"], user["names"]) == (10_001, ",".join(f"Ann {k}" for k in range(10_001)))
    converted = funnel.converted_users(funnel.converted_entries(many)).first()
    assert (converted["n"], converted["patient_ids"]) == (10_001, ",".join(["7"] * 10_001))
    found = funnel.converted_encounters(funnel.converted_encounter_entries(many)).first()
    assert (found["encounters"], found["encounter_ids"]) == (10_001, ",".join(sorted(str(k) for k in range(10_001))))


def test_distinct_entries(visits):
    entries = distinct_entries(visits, ["patient_id"], F.col("reason"), "reasons")
    got = {r["patient_id"]: (r["n"], r["reasons"]) for r in list_summary(entries, ["patient_id"], ["reasons"], page_rows=2).collect()}
    many = len({k % 13000 for k in range(BIG) if k % 5})
    assert got == {1: (many, None), 2: (8_000, None), 3: (2, "r1,r2"), None: (1, "r1")}


def test_sets_are_made_distinct_first(visits, spark):
    measures = {"rows": (F.lit(1).cast("long"), F.sum), "last": (F.col("n"), F.max)}
    lists = {"reasons": F.col("reason"), "parity": (F.col("n") % 2).cast("string"), "none": F.lit(None).cast("string")}
    found = set_summary(visits, ["patient_id"], measures, lists, by=F.col("n") % 2, parts={"odd": F.sum(F.when(F.col("_by") == "1", F.col("rows")))})
    got = {r["patient_id"]: r.asDict() for r in found.collect()}
    assert {k: (r["rows"], r["last"], r["odd"], r["parity"], r["none"]) for k, r in got.items()} == {
        1: (BIG, BIG - 1, BIG // 2, "0,1", None), 2: (10_000, 9_999, 5_000, "0,1", None), 3: (3, 2, 1, "0,1", None), None: (2, 1, 1, "0,1", None)}
    assert [got[k]["reasons"] for k in (1, 2, 3)] == [None, None, "r1,r2"]
    wide = set_summary(visits, ["patient_id"], measures, {"reasons": F.col("reason")}, set_values=10_000)
    texts = {r["patient_id"]: r["reasons"] for r in wide.collect()}
    assert texts[1] is None and texts[2] == ",".join(sorted(f"r{k}" for k in range(10_000) if k % 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "WindowGroupLimit" in plan
    assert distinct_values(visits, ["patient_id"], lists).groupBy("patient_id", "list").count().count() == 8
    assert set_summary(visits.limit(0), ["patient_id"], measures, lists).collect() == []


def test_ledger(spark, capsys):
    ledger = Ledger()
    frame = ledger.watch(spark.range(100).withColumn("odd", F.col("id") % 2), "read", rows=F.count("*"), odd=F.sum("odd"))
    kept = ledger.stage(frame.where("odd = 1"), "kept", rows=F.count("*"), greatest=F.max("id"))
    empty = ledger.stage(kept.where("id < 0"), "empty", rows=F.count("*"), greatest=F.max("id"))
    assert ledger.values() == {("read", "rows"): 100, ("read", "odd"): 50, ("kept", "rows"): 50, ("kept", "greatest"): 99, ("empty", "rows"): 0, ("empty", "greatest"): None}
    assert sorted((r["stage"], r["metric"]) for r in ledger.rows(spark).collect()) == sorted(ledger.values()) and empty.count() == 0
    # Metrics come from the driver, not from a scan.
    ledger.rows(spark).explain()
    assert "FileScan" not in capsys.readouterr().out


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [(e, i, c, a, h, s) for e, i, c, a, h, s in [
        (1, 1, True, True, True, True), (1, 2, True, True, False, False), (2, 3, False, True, False, False), (40_000, 4, False, False, True, False),
        (40_000, 5, True, True, None, False), (None, 6, True, True, True, True), (-5, 7, True, False, True, False), (1, 8, True, True, True, False)]]
    return spark.createDataFrame(rows, "encounter_id long, item_id int, answered_compat boolean, answered boolean, in_house boolean, same_day boolean")


def test_split_counts_are_exact(flagged):
    got = {r["split"]: (r["labs"], r["encounters"]) for r in labs.split_counts(flagged).collect()}
    want = {}
    for name in labs.SPLITS:
        row = labs.split(flagged, name).agg(F.count("*"), F.countDistinct("encounter_id")).first()
        want[name] = (row[0], row[1])
    assert got == want and want["with_result"] == (6, 3)
    assert {(r["labs"], r["encounters"]) for r in labs.split_counts(flagged.limit(0)).collect()} <= {(0, 0)}


def test_splits_read_their_own_folders(flagged):
    staged = stage(flagged, "labs", labs.SPLIT_COLUMNS)
    assert staged.columns == flagged.columns and staged.schema == flagged.schema
    for name in labs.SPLITS:
        assert sorted(r["item_id"] for r in labs.split(staged, name).collect()) == sorted(r["item_id"] for r in labs.split(flagged, name).collect())
        plan = labs.split(staged, name)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and "PushedFilters: []" in plan
    read = {r[0] for r in labs.split(staged, "waiting_sent_out").select(F.input_file_name()).collect()}
    assert read and all("answered_compat=false" in f and "in_house=false" in f for f in read)


def test_dimensions_share_a_scan(spark):
    claims = spark.createDataFrame([(1, "Ann", "p", "X", "hi"), (1, "Ann", "p", "X", "hi"), (2, "Ann", "p", None, "lo"), (3, None, "q", "X", None), (2, "Ann", "p", "Y", "lo")],
                                   "claim_no int, resource_provider_name string, period string, payer_class string, quality_level string")
    both = fiscal.claim_counts_by(claims, ["payer_class", "quality_level"])
    for dim in ("payer_class", "quality_level"):
        assert sorted(map(tuple, fiscal.of_dimension(both, dim).collect()), key=str) == sorted(map(tuple, fiscal.claim_counts(claims, dim).collect()), key=str)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    lines = spark.createDataFrame([(1, "p", 2.5), (1, "q", 1.0), (2, "p", 4.0), (9, "p", 8.0)], "claim_no int, period string, payment double")
    money = fiscal.money_reports(lines, claims, ["payer_class", "quality_level"])
    for dim in ("payer_class", "quality_level"):
        want = fiscal.money_report(lines, claims, dim).select("resource_provider_name", "period", dim, "total_payment")
        assert sorted(map(tuple, fiscal.of_dimension(money, dim).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
