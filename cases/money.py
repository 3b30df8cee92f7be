"""Appointment snapshot, fiscal claims and money, provider scorecard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from caretally.operators.aggs import money
from caretally.operators.dedup import claim_map
from caretally.plans import fiscal, scorecard, snapshot
from cases import tables as t

START, END = date(2024, 1, 1), date(2024, 1, 10)
SITES = ("NATION_2", "NATION_5")


def _window(spark, d):
    visits = t.visits(spark, d).drop("dob")
    return snapshot.visits_in_window(visits, t.facilities(spark, d), START, END)


def _insured(spark, d):
    return snapshot.claims_with_insurance(t.claims(spark, d), t.insurance(spark, d))


def _snapshot(spark, d):
    return snapshot.patient_snapshot(_window(spark, d), t.claims(spark, d), t.insurance(spark, d))


def _fanout(spark, d):
    claims = _insured(spark, d).select("patient_id", "claim_no", "service_date", "primary_insurance_id", "primary_insurance_class")
    visits = _window(spark, d).select("patient_id", "encounter_id", *snapshot.VISIT_COLUMNS)
    return snapshot.visit_claims(visits, claims)


def _period_claims(spark, d, claims):
    return fiscal.within_periods(claims, "service_date", t.calendar(spark, d), t.PERIODS)


def _with(spark, d):
    return _period_claims(spark, d, t.claims_with(spark, d))


def _single(spark, d):
    return fiscal.one_per_claim(t.claims_with(spark, d), t.LINE_TIE)


def _revenue(spark, d):
    return fiscal.within_periods(t.applied_revenue(spark, d), "service_date", t.calendar(spark, d), t.PERIODS)


def _revenue_of_periods(spark, d):
    """Lines staged by period; the periods of one summer are asked for by a filter of the calendar."""
    calendar = t.calendar(spark, d)
    staged = fiscal.by_month(t.applied_revenue(spark, d), "service_date", calendar)
    wanted = calendar.where((F.col("dates") >= "1996-06-01") & (F.col("dates") < "1996-09-01"))
    kept = fiscal.of_periods(staged, wanted)
    return kept.groupBy("period").agg(F.count("*").alias("lines"), F.sum(money("payment")).cast("double").alias("total_payment"))


def _collections(spark, d):
    return fiscal.within_periods(t.deposited_revenue(spark, d), "deposit_date", t.calendar(spark, d), t.PERIODS)


def _money(lines, claims, dim):
    return lambda spark, d: fiscal.money_report(lines(spark, d), claims(spark, d), dim)


def _calendar_enrich(spark, d):
    return fiscal.with_period(t.applied_revenue(spark, d), "service_date", t.calendar(spark, d)).withColumn(
        "payment", F.col("payment").cast("double")
    )


def _checked_out(spark, d):
    orders = t.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("visit_status"), F.to_date("o_orderdate").alias("appointment_date")
    )
    return fiscal.with_period(fiscal.checked_out(orders, "not spec"), "appointment_date", t.calendar(spark, d))


def _key_agreement(spark, d):
    return fiscal.key_pairs(_revenue(spark, d), _single(spark, d))


def _claims_star(spark, d):
    dims = t.star_dimensions(spark, d)
    dims.pop("cpts")
    return scorecard.claims_star(t.fact(spark, d), **dims)


def _procedure_star(spark, d):
    return scorecard.procedure_star(t.fact(spark, d), **t.star_dimensions(spark, d), year="Y98")


STAR_COLUMNS = ("l_orderkey", "cpt_id", "resource_provider_name", "facility_group_name", "primary_insurance_class",
                "visit_type", *scorecard.CALENDAR)
PROCEDURE_COLUMNS = ("l_orderkey", "cpt_id", "cpt_provider_allocated_id", "resource_provider_name", "visit_type_description",
                     "cpt_group", "cpt_description", "facility_group_name", "primary_insurance_name",
                     "primary_insurance_group", *scorecard.CALENDAR)


def _clinic(spark, d):
    rows = scorecard.clinic_rows(_claims_star(spark, d), "Y98", "NATION_1")
    return scorecard.scorecard(rows, "visit_type", "CLINIC")


def _hospital(spark, d):
    rows = scorecard.hospital_rows(_procedure_star(spark, d), "NATION_1", ["WIDGET", "gear"])
    return scorecard.scorecard(rows, "cpt_group", "HOSPITAL")


MONEY_DIMENSIONS = ["quality_level", "visit_type_classification"]

QUERIES = {
    "visit_window_facility": lambda s, d: _window(s, d),
    "patient_claim_fanout": _fanout,
    "patient_max_snapshot": _snapshot,
    "site_subset": lambda s, d: snapshot.site_report(_snapshot(s, d), SITES),
    "calendar_enrich": _calendar_enrich,
    "checked_out_visits": _checked_out,
    "claims_by_payer": lambda s, d: fiscal.claim_counts(_with(s, d), "payer_class"),
    "claims_by_quality": lambda s, d: fiscal.claim_counts(_with(s, d), "quality_level"),
    "claims_by_vtype": lambda s, d: fiscal.claim_counts(
        _period_claims(s, d, t.claims_without(s, d)), "visit_type_classification"
    ),
    # Two dimensions from one scan of the claims; money of two from one join.
    "claims_by_dimension": lambda s, d: fiscal.claim_counts_by(_with(s, d), ["payer_class", "quality_level"]),
    "revenue_by_dimension": lambda s, d: fiscal.money_reports(_revenue(s, d), t.claims_without(s, d), MONEY_DIMENSIONS),
    "collections_by_dimension": lambda s, d: fiscal.money_reports(_collections(s, d), t.claims_without(s, d), MONEY_DIMENSIONS),
    "revenue_of_periods": _revenue_of_periods,
    "claims_dedup": lambda s, d: _single(s, d).select(
        "claim_no", "encounter_id", "resource_provider_name", "payer_class", "quality_level", "service_date"
    ),
    "revenue_by_payer": _money(_revenue, _single, "payer_class"),
    "revenue_by_quality": _money(_revenue, t.claims_without, "quality_level"),
    "revenue_by_vtype": _money(_revenue, t.claims_without, "visit_type_classification"),
    "collections_by_payer": _money(_collections, _single, "payer_class"),
    "collections_by_quality": _money(_collections, t.claims_without, "quality_level"),
    "collections_by_vtype": _money(_collections, t.claims_without, "visit_type_classification"),
    # Claims that repeat per procedure: each line counts once per repeat.
    "revenue_repeated_claims": _money(_revenue, t.claims_with, "payer_class"),
    "key_agreement": _key_agreement,
    "claims_star": lambda s, d: _claims_star(s, d).select(*STAR_COLUMNS),
    "procedure_star": lambda s, d: _procedure_star(s, d).select(*PROCEDURE_COLUMNS),
    "scorecard_clinic": _clinic,
    "scorecard_hospital": _hospital,
    "scorecard_all": lambda s, d: scorecard.stacked(_clinic(s, d), _hospital(s, d)),
    "claim_map": lambda s, d: claim_map(
        t.claims(s, d).select("claim_no", F.col("primary_insurance_id").alias("encounter_id"), "patient_id")
    ),
    "claim_map_encounter": lambda s, d: claim_map(
        t.claims(s, d).select("claim_no", F.col("primary_insurance_id").alias("encounter_id"), "patient_id"), "encounter"
    ),
}

# --- oracle ------------------------------------------------------------------

WINDOW = f"""
SELECT v.patient_id, v.encounter_id, v.appointment_date, v.visit_status, v.is_new_patient, v.general_visit_status_id,
       v.np_flag, v.visit_type, v.facility_group_id, n.n_name AS facility_group_name
FROM ({t.VISITS_SQL}) v LEFT JOIN nation n ON n.n_nationkey = v.facility_group_id
WHERE v.appointment_date >= DATE '2024-01-01' AND v.appointment_date < DATE '2024-01-10'
"""

SNAPSHOT = f"""
WITH v AS ({WINDOW}), c AS ({t.CLAIMS_SQL}),
last_visit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
    ORDER BY appointment_date DESC, encounter_id DESC) AS r FROM v) WHERE r = 1),
top AS (SELECT patient_id, max(coalesce(primary_insurance_id, 0)) AS mi, max(primary_insurance_class) AS mc FROM c GROUP BY 1),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY service_date DESC NULLS LAST,
    claim_no DESC, primary_insurance_id DESC NULLS LAST) AS r FROM c) WHERE r = 1)
SELECT l.patient_id, l.facility_group_name, l.general_visit_status_id, l.is_new_patient, l.appointment_date,
       coalesce(top.mi, 0) AS max_insurance_id, top.mc AS max_insurance_class,
       latest.primary_insurance_id AS latest_insurance_id, latest.primary_insurance_class AS latest_insurance_class
FROM last_visit l LEFT JOIN top ON top.patient_id = l.patient_id LEFT JOIN latest ON latest.patient_id = l.patient_id
"""

SINGLE = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_no ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_shipdate) AS r FROM ({t.CLAIMS_WITH_SQL})) WHERE r = 1
"""
REVENUE = f"""
SELECT l.l_orderkey AS claim_no, l.l_partkey AS encounter_id, l.l_extendedprice AS payment, f.period
FROM lineitem l LEFT JOIN ({t.CALENDAR_SQL}) f ON f.dates = CAST(l.l_shipdate AS DATE)
"""
COLLECTIONS = f"""
SELECT l.l_orderkey AS claim_no, l.l_extendedprice AS payment, f.period
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN ({t.CALENDAR_SQL}) f ON f.dates = CAST(o.o_orderdate AS DATE)
"""


def _money_sql(lines, claims, dim):
    return f"""
SELECT c.resource_provider_name, a.period, c.{dim},
       CAST(coalesce(sum(CAST(a.payment AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_payment
FROM ({lines}) a LEFT JOIN ({claims}) c ON c.claim_no = a.claim_no
WHERE a.period IN {t.PERIODS} GROUP BY 1, 2, 3
"""


def _counts_sql(claims, dim):
    return f"""
SELECT c.resource_provider_name, f.period, c.{dim}, count(DISTINCT c.claim_no) AS claims
FROM ({claims}) c LEFT JOIN ({t.CALENDAR_SQL}) f ON f.dates = c.service_date
WHERE f.period IN {t.PERIODS} GROUP BY 1, 2, 3
"""


def _each_sql(report, dims, measure):
    """The reports of several dimensions, one under another."""
    return " UNION ALL ".join(
        f"SELECT '{dim}' AS dimension, {dim} AS value, resource_provider_name, period, {measure} FROM ({report(dim)})" for dim in dims
    )


def _score_sql(provider, visit_type, location, where):
    return f"""
SELECT {provider} AS provider, calendar_period AS period, calendar_year AS year, calendar_week AS week,
       complexity_level, primary_insurance_class, {visit_type} AS visit_type,
       CAST(sum(is_billable) AS BIGINT) AS visits,
       CAST(round(sum(CAST(payment AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue,
       CAST(sum(new_patient) AS BIGINT) AS new_patients, '{location}' AS location
FROM ({t.STAR_SQL}) WHERE calendar_year = 'Y98' AND is_billable = 1 AND visit_type IS NOT NULL AND {where}
GROUP BY 1, 2, 3, 4, 5, 6, 7
"""


CLINIC = _score_sql("resource_provider_name", "visit_type", "CLINIC",
                    "facility_group_name ILIKE 'NATION_1%' AND primary_insurance_class IS NOT NULL")
HOSPITAL = _score_sql("allocated_provider_name", "cpt_group", "HOSPITAL",
                      "facility_group_name NOT ILIKE 'NATION_1%' AND cpt_description NOT ILIKE '%WIDGET%' "
                      "AND cpt_description NOT ILIKE '%gear%'")
_WITHOUT = t.CLAIMS_WITHOUT_SQL

ORACLE = {
    "visit_window_facility": WINDOW,
    "patient_claim_fanout": f"""
SELECT v.patient_id, v.encounter_id, v.facility_group_name, v.general_visit_status_id, v.is_new_patient, v.appointment_date,
       c.claim_no, c.service_date, coalesce(c.primary_insurance_id, 0) AS primary_insurance_id, c.primary_insurance_class
FROM ({WINDOW}) v LEFT JOIN ({t.CLAIMS_SQL}) c ON c.patient_id = v.patient_id""",
    "patient_max_snapshot": SNAPSHOT,
    "site_subset": f"SELECT * FROM ({SNAPSHOT}) WHERE facility_group_name IN {SITES}",
    "calendar_enrich": f"""
SELECT l.l_orderkey AS claim_no, l.l_partkey AS encounter_id, l.l_extendedprice AS payment,
       CAST(l.l_shipdate AS DATE) AS service_date, f.period
FROM lineitem l LEFT JOIN ({t.CALENDAR_SQL}) f ON f.dates = CAST(l.l_shipdate AS DATE)""",
    "checked_out_visits": f"""
SELECT o.o_orderkey, o.o_orderpriority AS visit_status, CAST(o.o_orderdate AS DATE) AS appointment_date, f.period
FROM orders o LEFT JOIN ({t.CALENDAR_SQL}) f ON f.dates = CAST(o.o_orderdate AS DATE)
WHERE lower(o.o_orderpriority) LIKE '%not spec%'""",
    "claims_by_payer": _counts_sql(t.CLAIMS_WITH_SQL, "payer_class"),
    "claims_by_quality": _counts_sql(t.CLAIMS_WITH_SQL, "quality_level"),
    "claims_by_vtype": _counts_sql(_WITHOUT, "visit_type_classification"),
    "claims_by_dimension": _each_sql(lambda dim: _counts_sql(t.CLAIMS_WITH_SQL, dim), ["payer_class", "quality_level"], "claims"),
    "revenue_by_dimension": _each_sql(lambda dim: _money_sql(REVENUE, _WITHOUT, dim), MONEY_DIMENSIONS, "total_payment"),
    "collections_by_dimension": _each_sql(lambda dim: _money_sql(COLLECTIONS, _WITHOUT, dim), MONEY_DIMENSIONS, "total_payment"),
    "revenue_of_periods": f"""
SELECT f.period, count(*) AS lines, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_payment
FROM lineitem l JOIN ({t.CALENDAR_SQL}) f ON f.dates = CAST(l.l_shipdate AS DATE)
WHERE f.period IN ('FY96 - 6', 'FY96 - 7', 'FY96 - 8') GROUP BY 1""",
    "claims_dedup": "SELECT claim_no, encounter_id, resource_provider_name, payer_class, quality_level, service_date "
                    f"FROM ({SINGLE})",
    "revenue_by_payer": _money_sql(REVENUE, SINGLE, "payer_class"),
    "revenue_by_quality": _money_sql(REVENUE, _WITHOUT, "quality_level"),
    "revenue_by_vtype": _money_sql(REVENUE, _WITHOUT, "visit_type_classification"),
    "collections_by_payer": _money_sql(COLLECTIONS, SINGLE, "payer_class"),
    "collections_by_quality": _money_sql(COLLECTIONS, _WITHOUT, "quality_level"),
    "collections_by_vtype": _money_sql(COLLECTIONS, _WITHOUT, "visit_type_classification"),
    "revenue_repeated_claims": _money_sql(REVENUE, t.CLAIMS_WITH_SQL, "payer_class"),
    "key_agreement": f"""
SELECT a.encounter_id, c.encounter_id AS claim_encounter_id
FROM ({REVENUE}) a LEFT JOIN ({SINGLE}) c ON c.claim_no = a.claim_no WHERE a.period IN {t.PERIODS}""",
    "claims_star": f"SELECT {', '.join(STAR_COLUMNS)} FROM ({t.STAR_SQL})",
    "procedure_star": "SELECT " + ", ".join(PROCEDURE_COLUMNS).replace(
        "resource_provider_name", "allocated_provider_name AS resource_provider_name"
    ) + f" FROM ({t.STAR_SQL}) WHERE calendar_year = 'Y98'",
    "scorecard_clinic": CLINIC,
    "scorecard_hospital": HOSPITAL,
    "scorecard_all": f"{CLINIC} UNION ALL {HOSPITAL}",
    "claim_map": f"SELECT DISTINCT claim_no, primary_insurance_id AS encounter_id, patient_id FROM ({t.CLAIMS_SQL})",
    "claim_map_encounter": f"""
SELECT claim_no, primary_insurance_id AS encounter_id, patient_id FROM (SELECT *, row_number() OVER (
    PARTITION BY primary_insurance_id ORDER BY claim_no, patient_id) AS r FROM ({t.CLAIMS_SQL})) WHERE r = 1""",
}
