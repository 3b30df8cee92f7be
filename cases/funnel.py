"""Booking log, invoices, visit sequences, cohorts and billing."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretally.operators.aggs import run_metrics
from caretally.operators.dedup import claim_map
from caretally.operators.lists import list_pages, ordered_list
from caretally.operators.sequence import ordinal_mix
from caretally.operators.skew import hot_keys, stage_by
from caretally.plans import funnel
from caretally.session import stage
from cases import tables as t

DONE = "purchase"
SITES = ("signup", "purchase", "view")


# --- log ---------------------------------------------------------------------


def _envelope(spark, d):
    """Change log as JSON text built from each event: a text value, a number, a
    null, a field that is no object; for errors a text cut short, for clicks text behind
    the object, and for signups a value that is an object."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"FacilityName":{"OldValue":"","NewValue":"'), kind, F.lit('"},"VisitType":{"NewValue":'), k,
        F.lit('},"Reason":{"NewValue":null},"Notes":"plain","ProviderName":{"OldValue":"x"}}'),
    )
    nested = F.concat(F.lit('{"FacilityName":{"NewValue":{"k":['), k, F.lit(']}},"VisitType":{"NewValue":true}}'))
    cut = F.when(kind == "error", F.lit('{"FacilityName":{"NewV')).when(kind == "click", F.concat(body, F.lit(" // end")))
    cut = cut.when(kind == "signup", nested).otherwise(body)
    return t.table(spark, d, "events").select("event_id", cut.alias("log_details"), "props")


def _json_fields(spark, d):
    fields = ("FacilityName", "VisitType", "Reason", "Notes", "ProviderName")
    rows = funnel.log_with_fields(_envelope(spark, d), fields)
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), *fields)


def _log_sites(spark, d):
    """Notes of purchases name a date of birth."""
    named = F.concat(F.lit("seen. DOB: "), F.date_format("modify_date", "dd/MM/yyyy"), F.lit("; "), F.col("Notes"))
    log = t.log(spark, d).withColumn("Notes", F.when(F.col("FacilityName") == "purchase", named).otherwise(F.col("Notes")))
    rows = funnel.site_log(log, SITES)
    return rows.select("patient_id", "encounter_id", "FacilityName", "dob")


def _log_rows(spark, d):
    """As above; views have blank notes, and clicks none."""
    kind = F.col("FacilityName")
    named = F.concat(F.lit("seen. DOB: "), F.date_format("modify_date", "dd/MM/yyyy"))
    notes = F.when(kind == "purchase", named).when(kind == "view", F.lit("  ")).when(kind != "click", F.col("Notes"))
    rows = funnel.site_log(t.log(spark, d).withColumn("Notes", notes), (*SITES, "click"))
    return funnel.log_rows(rows).select("patient_id", "encounter_id", "FacilityName", "dob")


def _joined(spark, d):
    """Log with its encounters; label = encounter, good quality = checked out."""
    encounters = t.table(spark, d, "labels").select(
        F.col("doc_id").alias("encounter_id"),
        F.when(F.col("quality") == 1, funnel.CHECKED_OUT).otherwise("open").alias("visit_status"),
        F.lit(None).cast("date").alias("appointment_date"),
        F.col("toxic").cast("string").alias("appointment_provider_name"),
    )
    return funnel.log_encounters(t.log(spark, d), encounters)


def _converted_entries(spark, d):
    return funnel.converted_entries(_joined(spark, d), show=["encounter_id", "Reason"])


JOINED_COLUMNS = ("patient_id", "encounter_id", "Reason", "matched_encounter_id", "visit_status", "appointment_provider_name")


# --- invoices ----------------------------------------------------------------


def _raw_invoices(spark, d):
    """Event = invoice; its time is written in three ways and not at all."""
    ts, kind = F.col("ts"), F.col("event_type")
    text = (
        F.when(kind == "view", F.date_format(ts, "M/d/yyyy h:mm a"))
        .when(kind == "click", F.date_format(ts, "MM/dd/yyyy HH:mm"))
        .when(kind == "error", F.lit("13/45/2024"))
        .otherwise(F.date_format(ts, "MM/dd/yyyy"))
    )
    return t.table(spark, d, "events").select(
        "event_id",
        text.alias("BookingTime"),
        F.date_format(ts, "M/d/yyyy h:mm a").alias("AppointmentTime"),
        F.lit("").alias("PatientDateOfBirth"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("PatientEmail"),
        kind.alias("PatientFirstName"),
        F.nullif(F.get_json_object("props", "$.k"), F.lit("7")).alias("PatientLastName"),
        F.when(F.col("value") > 50, "Yes").otherwise("No").alias("Premium"),
    )


def _invoices(spark, d, cutoff="01/20/2024", mode="date"):
    return funnel.invoices_until(funnel.standard_invoices(_raw_invoices(spark, d)), cutoff, mode)


def _cutoff(mode):
    def run(spark, d):
        orders = t.table(spark, d, "orders").select(
            "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("BookingTime")
        )
        kept = funnel.invoices_until(orders, "06/15/1998", mode)
        return kept.groupBy("month", "week").agg(F.count("*").alias("bookings"), F.min("day").alias("first_day"))

    return run


BILLED_COLUMNS = ["event_id", "BookingTime", "week"]


def _billed_entries(spark, d):
    return funnel.billed_entries(_invoices(spark, d), ["event_id"], show=BILLED_COLUMNS)


def _billed_users(spark, d):
    return funnel.billed_users(_billed_entries(spark, d), show=BILLED_COLUMNS)


# --- sequences ---------------------------------------------------------------


def _visits_joined(spark, d):
    return t.visits(spark, d).withColumn("matched_encounter_id", F.col("encounter_id"))


def _hot_patients(spark, d):
    """One look at the base table serves every numbering of its rows by patient."""
    return hot_keys(t.table(spark, d, "events").select("user_id"), ["user_id"])


def _sequence(spark, d):
    return funnel.sequence(_visits_joined(spark, d), DONE, hot=_hot_patients(spark, d))


def _masked(spark, d):
    hot = _hot_patients(spark, d)
    return funnel.conversions(funnel.sequence(_visits_joined(spark, d), DONE, hot=hot), hot=hot)


def _two_dobs(spark, d):
    """A patient's short visits are filed under another date of birth: numbered by
    themselves, masked together with the rest."""
    other = F.when(F.col("visit_type") == "short", F.concat("dob", F.lit("?"))).otherwise(F.col("dob"))
    hot = _hot_patients(spark, d)
    return funnel.conversions(funnel.sequence(_visits_joined(spark, d).withColumn("dob", other), DONE, hot=hot), hot=hot)


SEQUENCE_COLUMNS = ("patient_id", "dob", "encounter_id", "visit_status", "rn", "is_converted", "converted_rn", "conversions_so_far")
MASKED_COLUMNS = ("patient_id", "encounter_id", "rn", "converted_rn", "conversions_so_far")


def _signups(spark, d):
    """The channel's log: entries for signups only."""
    return t.log(spark, d).where(F.col("FacilityName") == "signup")


def _first_users(spark, d):
    converted = funnel.one_per_patient(_masked(spark, d)).select("patient_id", "converted_rn")
    return funnel.with_first_seen(converted, _signups(spark, d))


def _since(spark, d):
    visits = t.plain_visits(spark, d).select(
        "patient_id", "encounter_id", "appointment_date", "visit_status", "visit_type", "np_flag"
    )
    return funnel.visits_since_first(visits, _first_users(spark, d), DONE)


def _since_staged(spark, d):
    """For results that read it more than once."""
    return stage(_since(spark, d), "since")


def _validator(spark, d, since=None):
    return funnel.cohort_validator(since or _since(spark, d))


def _claim_map(spark, d):
    """Order = encounter, order = claim."""
    pairs = t.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_no"), F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id")
    )
    return claim_map(pairs)


def _billing(spark, d, since=None):
    """Charges are the order's lines, taken as served on the shipping day in 2024."""
    charges = t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_no"),
        F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("l_shipdate")).alias("service_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("payment"),
        F.col("l_quantity").alias("billed_charge"),
    )
    return funnel.billing_since_first(since or _since(spark, d), _claim_map(spark, d), charges)


BILLING_COLUMNS = ("patient_id", "encounter_id", "claim_no", "payment", "billed_charge")


def _billing_out(frame):
    return frame.select(*BILLING_COLUMNS).withColumn("payment", F.col("payment").cast("double"))


def _members(spark, d, which, rule="one", since=None):
    return funnel.cohort(_validator(spark, d, since), which, rule)


def _cohort_visits(which):
    def run(spark, d):
        since = _since_staged(spark, d)
        return funnel.cohort_visits(since, _members(spark, d, which, since=since))

    return run


def _cohort_billing(spark, d):
    since = _since_staged(spark, d)
    return _billing_out(funnel.cohort_billing(_billing(spark, d, since), _members(spark, d, "new", since=since)))


def _billing_totals(spark, d):
    since = _since_staged(spark, d)
    return funnel.billing_totals(_billing(spark, d, since), _validator(spark, d, since))


def _billing_totals_bucketed(spark, d):
    """Visits and charges dealt to buckets of the patient once; totals and cohorts read them as they lie."""
    since = stage_by(_since_staged(spark, d), "since", ["patient_id"])
    billing = stage_by(stage(_billing(spark, d, since), "billing"), "billing", ["patient_id"])
    return funnel.billing_totals(billing, _validator(spark, d, since))


def _last_new(spark, d):
    return funnel.cohort_last_entries(_members(spark, d, "new", "nonzero"), t.log(spark, d))


def _metrics(spark, d):
    return run_metrics(
        [
            ("log", t.log(spark, d), {"rows": F.count("*"), "patients": F.countDistinct("patient_id"), "reasons": F.count("Reason")}),
            ("conversions", _masked(spark, d), {"rows": F.count("*"), "patients": F.countDistinct("patient_id")}),
            ("invoices", funnel.standard_invoices(_raw_invoices(spark, d)),
             {"rows": F.count("*"), "bad_dates": F.count_if(F.col("BookingTime").isNull())}),
        ]
    )


def _since_first_lines(spark, d):
    """Lines of each customer's later orders: order date on or after the first."""
    orders = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("encounter_id"),
        F.to_date("o_orderdate").alias("appointment_date"), F.col("o_orderstatus").alias("visit_status"),
    )
    firsts = funnel.first_seen(orders.where(F.col("visit_status") == "F"))
    return funnel.visits_since_first(orders, firsts, "O")


QUERIES = {
    "json_fields": _json_fields,
    "log_sites": _log_sites,
    "log_rows": _log_rows,
    "invoice_rows": lambda s, d: funnel.invoice_rows(funnel.standard_invoices(_raw_invoices(s, d))).select(
        "event_id", *funnel.INVOICE_DATES
    ),
    "log_last": lambda s, d: funnel.last_entries(t.log(s, d)),
    "log_first": lambda s, d: funnel.first_seen(t.log(s, d)),
    "log_summary": lambda s, d: funnel.log_summary(funnel.log_entries(t.log(s, d))),
    "log_summary_short": lambda s, d: funnel.log_summary(funnel.log_entries(t.log(s, d)), page_rows=25),
    "log_entries": lambda s, d: funnel.log_entries(t.log(s, d)),
    "log_pages": lambda s, d: list_pages(funnel.log_entries(t.log(s, d)), ["patient_id"], list(funnel.LOG_LISTS), page_rows=25),
    "log_summary_paged": lambda s, d: ordered_list(
        t.log(s, d), ["patient_id"], {"reasons": F.col("Reason")}, funnel.LOG_ORDER, page_rows=25
    ),
    "date_standardise": lambda s, d: funnel.standard_invoices(_raw_invoices(s, d)).select(
        "event_id", *funnel.INVOICE_DATES
    ),
    "week_bucket": lambda s, d: _invoices(s, d).groupBy("month", "week").agg(F.count("*").alias("invoices")),
    "cutoff_text": _cutoff("text"),
    "cutoff_date": _cutoff("date"),
    "billed_users": _billed_users,
    "billed_entries": _billed_entries,
    "billed_by_week": lambda s, d: funnel.users_by_week(_billed_users(s, d)),
    "log_encounter_join": lambda s, d: _joined(s, d).select(*JOINED_COLUMNS),
    "converted_users": lambda s, d: funnel.converted_users(_converted_entries(s, d), show=["encounter_id", "Reason"]),
    "converted_entries": _converted_entries,
    "visit_sequence": lambda s, d: _sequence(s, d).select(*SEQUENCE_COLUMNS),
    "conversion_masked": lambda s, d: _masked(s, d).select(*MASKED_COLUMNS),
    "conversion_two_dobs": lambda s, d: _two_dobs(s, d).select(*MASKED_COLUMNS),
    "conversion_first": lambda s, d: funnel.one_per_patient(_masked(s, d)).select(*MASKED_COLUMNS),
    "ordinal_mix": lambda s, d: ordinal_mix(_masked(s, d)),
    "unique_converted": lambda s, d: funnel.converted_encounters(funnel.converted_encounter_entries(_masked(s, d))),
    "unique_converted_entries": lambda s, d: funnel.converted_encounter_entries(_masked(s, d)),
    "first_seen": lambda s, d: funnel.with_first_seen(
        t.plain_visits(s, d).select("patient_id", "encounter_id", "visit_status"), _signups(s, d)
    ),
    "visits_since_first": lambda s, d: _since(s, d),
    "orders_since_first": _since_first_lines,
    "cohort_validator": _validator,
    "cohort_visits": _cohort_visits("new"),
    "cohort_visits_established": _cohort_visits("established"),
    "billing_since_first": lambda s, d: _billing_out(_billing(s, d)),
    "cohort_billing": _cohort_billing,
    "billing_totals": _billing_totals,
    "billing_totals_bucketed": _billing_totals_bucketed,
    "cohort_last_log": _last_new,
    "reason_share": lambda s, d: funnel.reason_share(funnel.last_entries(t.log(s, d)), _last_new(s, d)),
    "run_metrics": _metrics,
}

# --- oracle ------------------------------------------------------------------

LAST = f"""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY modify_date DESC, encounter_id DESC) AS r
FROM ({t.LOG_SQL})) WHERE r = 1
"""
INVOICES = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS booked, ts,
       'u' || user_id || '@example.com' AS PatientEmail,
       event_type || ' ' || nullif(json_extract_string(props, '$.k'), '7') AS name,
       CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END AS Premium
FROM events
"""
WEEK = "CASE WHEN {0} <= 7 THEN 'S1' WHEN {0} <= 15 THEN 'S2' WHEN {0} <= 23 THEN 'S3' ELSE 'S4' END"
KEPT = f"SELECT *, {WEEK.format('day(booked)')} AS week FROM ({INVOICES}) WHERE booked <= DATE '2024-01-20'"
BILLED_ENTRIES = f"""
SELECT PatientEmail, row_number() OVER (PARTITION BY PatientEmail ORDER BY event_id) AS position, event_id,
       strftime(booked, '%m/%d/%Y') AS "BookingTime", week, name AS names FROM ({KEPT}) WHERE Premium = 'Yes'
"""
BILLED = f"""
SELECT PatientEmail, arg_min(event_id, event_id) AS event_id,
       arg_min(strftime(booked, '%m/%d/%Y'), event_id) AS "BookingTime", arg_min(week, event_id) AS week,
       count(*) AS n, string_agg(name, ',' ORDER BY event_id) AS names
FROM ({KEPT}) WHERE Premium = 'Yes' GROUP BY 1
"""
LOG_ENTRIES = f"""
SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY modify_date, encounter_id) AS position,
       Reason || '// ' AS reasons, VisitStatus || '// ' AS visit_statuses FROM ({t.LOG_SQL})
"""


def _log_summary_sql(limit):
    return f"""
SELECT patient_id, count(*) AS billed_times, CASE WHEN count(*) <= {limit} THEN string_agg(reasons, ',' ORDER BY position) END AS reasons,
       CASE WHEN count(*) <= {limit} THEN string_agg(visit_statuses, ',' ORDER BY position) END AS visit_statuses
FROM ({LOG_ENTRIES}) GROUP BY 1"""


def _cutoff_sql(where):
    return f"""
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {WEEK.format('day(o_orderdate)')} AS week, count(*) AS bookings,
       CAST(min(day(o_orderdate)) AS INTEGER) AS first_day FROM orders WHERE {where} GROUP BY 1, 2"""


JOINED = f"""
SELECT l.patient_id, l.encounter_id, l.appointment_date, l.Reason, b.doc_id AS matched_encounter_id,
       CASE WHEN b.doc_id IS NULL THEN NULL WHEN b.quality = 1 THEN 'CHK : Check Out' ELSE 'open' END AS visit_status,
       CAST(b.toxic AS VARCHAR) AS appointment_provider_name
FROM ({t.LOG_SQL}) l LEFT JOIN labels b ON b.doc_id = l.encounter_id
"""
SEQUENCE = f"""
SELECT patient_id, dob, encounter_id, appointment_date, visit_status, rn, is_converted,
       CASE WHEN is_converted = 1 THEN rn END AS converted_rn,
       CAST(sum(is_converted) OVER (PARTITION BY patient_id, dob ORDER BY rn) AS BIGINT) AS conversions_so_far
FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, dob ORDER BY appointment_date, encounter_id) AS rn,
             CASE WHEN visit_status = 'purchase' THEN 1 ELSE 0 END AS is_converted FROM ({t.VISITS_SQL}))
"""
MASKED = f"""
SELECT patient_id, encounter_id, appointment_date, rn,
       CASE WHEN row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date, encounter_id) = 1 THEN converted_rn END
           AS converted_rn,
       CASE WHEN row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date DESC, encounter_id DESC) = 1
            THEN conversions_so_far END AS conversions_so_far
FROM ({SEQUENCE}) WHERE is_converted = 1
"""
FIRSTS = "SELECT user_id AS patient_id, min(CAST(ts AS DATE)) AS first_seen FROM events WHERE event_type = 'signup' GROUP BY 1"
SINCE = f"""
SELECT v.patient_id, v.encounter_id, v.appointment_date, v.visit_status, v.visit_type, v.np_flag, m.converted_rn, f.first_seen
FROM ({t.VISITS_SQL}) v JOIN (SELECT patient_id, max(converted_rn) AS converted_rn FROM ({MASKED}) GROUP BY 1) m
  ON m.patient_id = v.patient_id
JOIN ({FIRSTS}) f ON f.patient_id = v.patient_id
WHERE v.visit_status = 'purchase' AND v.appointment_date >= f.first_seen
"""
VALIDATOR = f"""
SELECT patient_id, CAST(sum(np_flag) AS BIGINT) AS validator, min(first_seen) AS first_seen,
       string_agg(DISTINCT visit_type, ',' ORDER BY visit_type) AS visit_types FROM ({SINCE}) GROUP BY 1
"""
BILLING = f"""
SELECT DISTINCT s.*, l.l_orderkey AS claim_no, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS payment, l.l_quantity AS billed_charge
FROM ({SINCE}) s JOIN orders o ON o.o_orderkey = s.encounter_id JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE make_date(2024, 1, CAST(day(l.l_shipdate) AS INTEGER)) >= s.first_seen
"""
BILLING_OUT = "SELECT patient_id, encounter_id, claim_no, CAST(payment AS DOUBLE) AS payment, billed_charge"
LAST_NEW = f"""
SELECT v.patient_id, l.* EXCLUDE (patient_id) FROM ({VALIDATOR}) v LEFT JOIN ({LAST}) l ON l.patient_id = v.patient_id
WHERE v.validator <> 0
"""


def _cohort_visits_sql(flag):
    return f"""
SELECT c.patient_id, c.validator, c.first_seen, c.visit_types, s.first_seen AS start_date
FROM ({SINCE}) s JOIN ({VALIDATOR}) c ON c.patient_id = s.patient_id WHERE c.validator = {flag}"""


ORACLE = {
    "json_fields": """
SELECT event_id, json_extract_string(props, '$.k') AS k,
       CASE WHEN event_type = 'signup' THEN '{"k":[' || json_extract_string(props, '$.k') || ']}'
            WHEN event_type NOT IN ('error', 'click') THEN event_type END AS "FacilityName",
       CASE WHEN event_type = 'signup' THEN 'true'
            WHEN event_type NOT IN ('error', 'click') THEN json_extract_string(props, '$.k') END AS "VisitType",
       CAST(NULL AS VARCHAR) AS "Reason", CAST(NULL AS VARCHAR) AS "Notes", CAST(NULL AS VARCHAR) AS "ProviderName" FROM events""",
    "log_sites": f"""
SELECT patient_id, encounter_id, FacilityName,
       CASE WHEN FacilityName = 'purchase' THEN strftime(modify_date, '%d/%m/%Y') END AS dob FROM ({t.LOG_SQL}) WHERE FacilityName IN {SITES}""",
    "log_rows": f"""
SELECT patient_id, encounter_id, FacilityName, CASE WHEN FacilityName = 'purchase' THEN strftime(modify_date, '%d/%m/%Y')
       WHEN FacilityName IN ('view', 'click') THEN 'SIN NOTES' END AS dob FROM ({t.LOG_SQL}) WHERE FacilityName IN ('click', 'signup', 'purchase', 'view')""",
    "invoice_rows": """
SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%m/%d/%Y') ELSE 'Fecha no válida' END AS "BookingTime",
       strftime(ts, '%m/%d/%Y') AS "AppointmentTime", 'Fecha no válida' AS "PatientDateOfBirth" FROM events""",
    "log_last": LAST,
    "log_first": f"SELECT patient_id, min(appointment_date) AS first_seen FROM ({t.LOG_SQL}) GROUP BY 1",
    "log_summary": f"""
SELECT patient_id, count(*) AS billed_times, string_agg(reasons, ',' ORDER BY position) AS reasons,
       string_agg(visit_statuses, ',' ORDER BY position) AS visit_statuses FROM ({LOG_ENTRIES}) GROUP BY 1""",
    "log_summary_short": _log_summary_sql(25),
    "log_entries": LOG_ENTRIES,
    "log_pages": f"""
SELECT patient_id, (position - 1) // 25 AS page, string_agg(reasons, ',' ORDER BY position) AS reasons,
       string_agg(visit_statuses, ',' ORDER BY position) AS visit_statuses FROM ({LOG_ENTRIES}) GROUP BY 1, 2""",
    "log_summary_paged": f"""
SELECT patient_id, (rn - 1) // 25 AS page, sum(count(*)) OVER (PARTITION BY patient_id)::BIGINT AS n, string_agg(Reason, ',' ORDER BY rn) AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY modify_date, encounter_id) AS rn FROM ({t.LOG_SQL}))
GROUP BY 1, 2""",
    "date_standardise": """
SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%m/%d/%Y') END AS "BookingTime",
       strftime(ts, '%m/%d/%Y') AS "AppointmentTime", CAST(NULL AS VARCHAR) AS "PatientDateOfBirth" FROM events""",
    "week_bucket": f"SELECT CAST(month(booked) AS INTEGER) AS month, week, count(*) AS invoices FROM ({KEPT}) GROUP BY 1, 2",
    "cutoff_text": _cutoff_sql("strftime(o_orderdate, '%m/%d/%Y') <= '06/15/1998'"),
    "cutoff_date": _cutoff_sql("o_orderdate <= TIMESTAMP '1998-06-15'"),
    "billed_users": BILLED,
    "billed_entries": BILLED_ENTRIES,
    "billed_by_week": f"SELECT week, count(week) AS times FROM ({BILLED}) GROUP BY 1",
    "log_encounter_join": f"SELECT {', '.join(JOINED_COLUMNS)} FROM ({JOINED})",
    "converted_users": f"""
SELECT patient_id, arg_min(encounter_id, (appointment_date, encounter_id)) AS encounter_id,
       (array_agg(Reason ORDER BY appointment_date, encounter_id))[1] AS "Reason", count(*) AS n,
       string_agg(CAST(patient_id AS VARCHAR), ',') AS patient_ids
FROM ({JOINED}) WHERE visit_status = 'CHK : Check Out' GROUP BY 1""",
    "converted_entries": f"""
SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date, encounter_id) AS position, encounter_id, Reason,
       CAST(patient_id AS VARCHAR) AS patient_ids FROM ({JOINED}) WHERE visit_status = 'CHK : Check Out'""",
    "visit_sequence": f"SELECT {', '.join(SEQUENCE_COLUMNS)} FROM ({SEQUENCE})",
    "conversion_two_dobs": f"""
WITH v AS (SELECT * REPLACE (CASE WHEN visit_type = 'short' THEN dob || '?' ELSE dob END AS dob) FROM ({t.VISITS_SQL})),
n AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (WHERE visit_status = 'purchase') OVER w AS so_far
      FROM v WINDOW w AS (PARTITION BY patient_id, dob ORDER BY appointment_date, encounter_id))
SELECT patient_id, encounter_id, rn, CASE WHEN row_number() OVER p = 1 THEN rn END AS converted_rn,
       CASE WHEN row_number() OVER p = count(*) OVER (PARTITION BY patient_id) THEN so_far END AS conversions_so_far
FROM n WHERE visit_status = 'purchase' WINDOW p AS (PARTITION BY patient_id ORDER BY appointment_date, encounter_id)""",
    "conversion_masked": f"SELECT {', '.join(MASKED_COLUMNS)} FROM ({MASKED})",
    "conversion_first": f"""
SELECT {', '.join(MASKED_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
ORDER BY appointment_date, encounter_id) AS r FROM ({MASKED})) WHERE r = 1""",
    "ordinal_mix": f"""
SELECT count(*) FILTER (WHERE converted_rn = 1) AS ord_1, count(*) FILTER (WHERE converted_rn = 2) AS ord_2,
       count(*) FILTER (WHERE converted_rn = 3) AS ord_3, count(*) FILTER (WHERE converted_rn = 4) AS ord_4,
       count(*) FILTER (WHERE converted_rn BETWEEN 2 AND 4) AS later, count(*) FILTER (WHERE converted_rn >= 5) AS ord_5_plus,
       count(DISTINCT CASE WHEN converted_rn = 1 THEN patient_id END) AS first_visit_users, avg(converted_rn) AS mean_ordinal
FROM ({MASKED})""",
    "unique_converted": f"""
SELECT patient_id, count(*) AS encounters, string_agg(id, ',' ORDER BY id) AS encounter_ids
FROM (SELECT DISTINCT patient_id, CAST(encounter_id AS VARCHAR) AS id FROM ({MASKED})) GROUP BY 1""",
    "unique_converted_entries": f"""
SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_ids) AS position, encounter_ids
FROM (SELECT DISTINCT patient_id, CAST(encounter_id AS VARCHAR) AS encounter_ids FROM ({MASKED}))""",
    "first_seen": f"""
SELECT e.user_id AS patient_id, e.event_id AS encounter_id, e.event_type AS visit_status, f.first_seen
FROM events e LEFT JOIN ({FIRSTS}) f ON f.patient_id = e.user_id""",
    "visits_since_first": SINCE,
    "orders_since_first": """
SELECT o.o_custkey AS patient_id, o.o_orderkey AS encounter_id, CAST(o.o_orderdate AS DATE) AS appointment_date,
       o.o_orderstatus AS visit_status, CAST(f.first_seen AS DATE) AS first_seen
FROM orders o JOIN (SELECT o_custkey, min(o_orderdate) AS first_seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f
  ON f.o_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' AND o.o_orderdate >= f.first_seen""",
    "cohort_validator": VALIDATOR,
    "cohort_visits": _cohort_visits_sql(1),
    "cohort_visits_established": _cohort_visits_sql(0),
    "billing_since_first": f"{BILLING_OUT} FROM ({BILLING})",
    "cohort_billing": f"{BILLING_OUT} FROM ({BILLING}) WHERE patient_id IN (SELECT patient_id FROM ({VALIDATOR}) WHERE validator = 1)",
    "billing_totals": f"""
SELECT CAST(sum(b.payment) AS DOUBLE) AS total_payment,
       CAST(sum(CASE WHEN v.validator = 1 THEN b.payment END) AS DOUBLE) AS new_payment,
       CAST(sum(CASE WHEN v.validator = 0 THEN b.payment END) AS DOUBLE) AS established_payment
FROM ({BILLING}) b LEFT JOIN ({VALIDATOR}) v ON v.patient_id = b.patient_id""",
    "billing_totals_bucketed": f"""
SELECT CAST(sum(b.payment) AS DOUBLE) AS total_payment,
       CAST(sum(CASE WHEN v.validator = 1 THEN b.payment END) AS DOUBLE) AS new_payment,
       CAST(sum(CASE WHEN v.validator = 0 THEN b.payment END) AS DOUBLE) AS established_payment
FROM ({BILLING}) b LEFT JOIN ({VALIDATOR}) v ON v.patient_id = b.patient_id""",
    "cohort_last_log": LAST_NEW,
    "reason_share": f"""
SELECT a."Reason", a.booked, coalesce(n.new_patients, 0) AS new_patients
FROM (SELECT Reason, count(Reason) AS booked FROM ({LAST}) GROUP BY 1) a
LEFT JOIN (SELECT Reason, count(*) AS new_patients FROM ({LAST_NEW}) GROUP BY 1) n ON n.Reason = a.Reason""",
    "run_metrics": f"""
SELECT 'log' AS stage, m.metric, m.value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT user_id) AS DOUBLE) AS patients,
    CAST(count(nullif(event_type, 'error')) AS DOUBLE) AS reasons FROM events) UNPIVOT (value FOR metric IN (rows, patients, reasons)) m
UNION ALL SELECT 'conversions', m.metric, m.value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows,
    CAST(count(DISTINCT patient_id) AS DOUBLE) AS patients FROM ({MASKED})) UNPIVOT (value FOR metric IN (rows, patients)) m
UNION ALL SELECT 'invoices', m.metric, m.value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows,
    CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS bad_dates FROM events) UNPIVOT (value FOR metric IN (rows, bad_dates)) m""",
}
