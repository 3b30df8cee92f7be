"""Document review and lab turnaround."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.functions.dates import calendar_days, elapsed_days, lag_text, within
from caretally.operators.aggs import bucket_pivot, lag_summary
from caretally.operators.filters import split_by, without_nulls
from caretally.operators.skew import salted_join
from caretally.plans import documents, labs
from caretally.session import stage
from cases import tables as t

# --- documents ---------------------------------------------------------------


def _documents(spark, d):
    typed = documents.typed_documents(t.raw_documents(spark, d))
    return documents.month_of_documents(typed, 2023, 11)


def _assigned(spark, d):
    return documents.assigned_documents(_documents(spark, d), t.REVIEWERS, ["scan_date", "patient_id"])


def _lags(spark, d):
    report = documents.typed_report(t.raw_report(spark, d))
    return documents.review_lags(_assigned(spark, d), report, ["reviewed_date", "report_scanned_by"])


LAG_COLUMNS = ("doc_id", "patient_id", "reviewer_id", "reviewer_name", "scanned_by", "review", "reviewed_date",
               "report_scanned_by", "report_reviewer_name", "report_patient_id", "report_patient_name", "review_days",
               "in_time")


def _unreviewed(spark, d):
    return documents.unreviewed(_assigned(spark, d)).select(
        "reviewer_id", "reviewer_name", "scanned_by", "custom_name", "del_flag", "doc_id", "file_format", "file_name",
        "patient_id", "review",
    )


def _labelled(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return salted_join(docs, t.table(spark, d, "labels"), "doc_id", "left", unique_right=True)


def _answered_split(spark, d):
    """Labelled or not x chosen source or not."""
    sides = split_by(_labelled(spark, d), F.col("quality").isNotNull(), "answered")
    sides = split_by(sides, F.col("source").isin("src1", "src2", "src3"), "in_house")
    return labs.outcome_counts(sides.withColumnRenamed("doc_id", "encounter_id"), "answered")


# --- labs --------------------------------------------------------------------


def _labs(spark, d):
    return labs.with_lags(t.labs(spark, d), t.IN_HOUSE)


def _answered(spark, d):
    return _labs(spark, d).where("answered")


def _waiting(spark, d):
    return _labs(spark, d).where(~F.col("answered_compat"))


def _flagged(spark, d):
    return labs.with_same_day(_labs(spark, d))


def _lab_splits(spark, d):
    """Every split as a table of its own, read from one staged frame."""
    staged = stage(_flagged(spark, d), "labs", labs.SPLIT_COLUMNS)
    columns = ("encounter_id", "item_id", "assigned_to_id")
    halves = [labs.split(staged, n).select(F.lit(n).alias("split"), *columns) for n in labs.SPLITS]
    return reduce(DataFrame.unionByName, halves)


def _turnaround(spark, d):
    """Line with the days from order to shipment."""
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = salted_join(lines, orders, "l_orderkey", "left", unique_right=True)
    return joined.withColumn("days", calendar_days("o_orderdate", "l_shipdate"))


def _lag_bucket_pivot(spark, d):
    return bucket_pivot(_turnaround(spark, d), "l_suppkey", "days")


def _lag_elapsed(spark, d):
    """From each event to the last minute of the month: part-days count."""
    end, start = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), F.col("ts")
    return t.table(spark, d, "events").select(
        "event_id",
        elapsed_days(start, end).alias("days"),
        calendar_days(start, end).alias("calendar_days"),
        lag_text(end - F.date_trunc("second", start)).alias("lag_text"),
    )


def _sentinel(spark, d):
    marked = _labs(spark, d)
    return marked.groupBy("answered", "answered_compat", "reviewed").agg(
        F.count("*").alias("labs"),
        F.count("result_lag").alias("result_lags"),
        F.count("review_lag").alias("review_lags"),
        F.sum("result_days").alias("result_days"),
        F.sum(F.when(F.col("answered"), F.col("review_days"))).alias("review_days"),
    )


def _same_day(spark, d):
    frame = _labs(spark, d)
    halves = [
        half.groupBy("orderer_id").agg(F.count("*").alias("labs")).withColumn("half", F.lit(name))
        for name, half in (("same_day", labs.same_day_reviewed(frame)), ("other", labs.not_same_day_reviewed(frame)))
    ]
    return halves[0].unionByName(halves[1])


QUERIES = {
    "doc_review_join": lambda s, d: _lags(s, d).select(*LAG_COLUMNS),
    "doc_sla": lambda s, d: documents.reviewer_sla(_lags(s, d)),
    "doc_unreviewed": _unreviewed,
    "dropna_subset": lambda s, d: without_nulls(_labelled(s, d), ["quality"]),
    "answered_split": _answered_split,
    "doc_within": lambda s, d: _labelled(s, d).select("doc_id", within("toxic", 0).alias("flag")),
    "lag_bucket_pivot": _lag_bucket_pivot,
    "lag_elapsed": _lag_elapsed,
    "lag_calendar": lambda s, d: _turnaround(s, d).select("l_orderkey", "l_suppkey", "days"),
    "lag_histogram": lambda s, d: labs.lag_histogram(_turnaround(s, d), "days"),
    "reviewer_lag_lists": lambda s, d: lag_summary(
        _turnaround(s, d), "l_suppkey", "days", {"flags": "l_returnflag", "statuses": "l_linestatus"}
    ),
    "lab_outcomes": lambda s, d: labs.outcome_counts(_labs(s, d)),
    "lab_month_slice": lambda s, d: labs.month_of_results(t.labs(s, d), 1996, 11),
    "sentinel_lag": _sentinel,
    "lab_report_rows": lambda s, d: labs.report_rows(_labs(s, d)).select(
        "encounter_id", "item_id", "reviewed_by", "result_lag", "review_lag"
    ),
    "same_day_complement": _same_day,
    "lab_splits": _lab_splits,
    "lab_split_counts": lambda s, d: labs.split_counts(_flagged(s, d)),
    "reviewer_staff": lambda s, d: labs.reviewer_staff(_answered(s, d)),
    "reviewer_summary_short": lambda s, d: labs.reviewer_summary(_answered(s, d), set_values=3),
    "reviewer_summary": lambda s, d: labs.reviewer_summary(_answered(s, d)),
    "reviewer_buckets": lambda s, d: labs.reviewer_buckets(_answered(s, d)),
    "reviewer_bucket_detail": lambda s, d: labs.bucket_detail(_answered(s, d)),
    "review_histogram": lambda s, d: labs.lag_histogram(_answered(s, d)),
    "answered_unreviewed": lambda s, d: labs.answered_unreviewed(_answered(s, d)).select(
        "encounter_id", "item_id", "reviewed_by", "assigned_to_id"
    ),
    "pending_queue": lambda s, d: labs.pending_queue(labs.answered_unreviewed(_answered(s, d))),
    "waiting_queue": lambda s, d: labs.pending_queue(_waiting(s, d)),
    "encounter_summary": lambda s, d: labs.encounter_summary(_answered(s, d)),
    "encounter_summary_slow": lambda s, d: labs.encounter_summary(
        labs.not_same_day_reviewed(_labs(s, d)).where("answered")
    ),
    "waiting_encounters": lambda s, d: labs.encounter_counts(_waiting(s, d)),
}

# --- oracle ------------------------------------------------------------------

ASSIGNED = f"""
SELECT * FROM ({t.DOCS_SQL}) WHERE scan_day >= DATE '2023-11-01' AND scan_day < DATE '2023-12-01'
  AND reviewer_id IN {t.REVIEWERS} AND del_flag = 0
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY scan_day, patient_id) = 1
"""
LISTED = f"""
SELECT * FROM ({t.REPORT_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reviewed_date, report_scanned_by) = 1
"""
LAGS = f"""
SELECT a.*, r.* EXCLUDE (doc_id), date_diff('day', a.scan_day, r.reviewed_date) AS review_days,
       CASE WHEN date_diff('day', a.scan_day, r.reviewed_date) <= 5 THEN 1 ELSE 0 END AS in_time
FROM ({ASSIGNED}) a LEFT JOIN ({LISTED}) r ON r.doc_id = a.doc_id
"""
LABELLED = "SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
TURNAROUND = """
SELECT l.*, date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS days
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
"""
LABS, ANSWERED = t.LABS_SQL, f"SELECT * FROM ({t.LABS_SQL}) WHERE answered"
WAITING = f"SELECT * FROM ({t.LABS_SQL}) WHERE NOT answered_compat"


def _pivot(source, key, days, lists=""):
    return f"""
SELECT {key}, {lists} round(avg({days}), 2) AS avg_rev, count(*) AS labs,
       nullif(count(*) FILTER (WHERE {days} <= 3), 0) AS b1,
       nullif(count(*) FILTER (WHERE {days} > 3 AND {days} <= 5), 0) AS b2,
       nullif(count(*) FILTER (WHERE {days} > 5 AND {days} <= 7), 0) AS b3,
       nullif(count(*) FILTER (WHERE {days} > 7 AND {days} <= 14), 0) AS b4,
       nullif(count(*) FILTER (WHERE {days} > 14), 0) AS b5,
       round(CAST(count(*) FILTER (WHERE {days} <= 3) AS DOUBLE) / count(*), 2) AS share_b1,
       round(CAST(count(*) FILTER (WHERE {days} <= 5) AS DOUBLE) / count(*), 2) AS share_le_5,
       round(CAST(nullif(count(*) FILTER (WHERE {days} > 3 AND {days} <= 5), 0) AS DOUBLE) / count(*), 2) AS share_b2
FROM ({source}) GROUP BY {key}"""


def _distinct(expr, name):
    return f"string_agg(DISTINCT {expr}, ',' ORDER BY {expr}) AS {name}"


STAFF = ", ".join(
    [_distinct("assigned_to_id", "assigned_to"), _distinct("orderer_id || '//'", "ordered_by"),
     _distinct("orderer_name || '//'", "orderer_names")]
)
STAFF_PLAIN = STAFF.replace(" || '//'", "")


def _queue(source):
    return f"""
SELECT assigned_to_id, {_distinct('orderer_id', 'ordered_by')}, round(avg(review_days), 2) AS avg_rev, count(*) AS labs
FROM ({source}) GROUP BY 1"""


def _encounters(source):
    return f"""
SELECT encounter_id, count(*) AS labs, round(avg(review_days), 2) AS avg_rev,
       count(*) FILTER (WHERE NOT reviewed) AS pending FROM ({source}) GROUP BY 1"""


def _lag_text(interval):
    s = f"epoch({interval})"
    return (f"(CAST(floor({s} / 86400) AS BIGINT) || ' days ' || "
            f"strftime(TIMESTAMP '2000-01-01' + to_seconds({s} - 86400 * floor({s} / 86400)), '%H:%M:%S'))")


SAME_DAY = "result_days IS NOT NULL AND result_days = 0 AND reviewed"
SPLIT_TESTS = {
    "with_result": "answered_compat", "with_result_in_house": "answered_compat AND in_house",
    "with_result_sent_out": "answered_compat AND NOT in_house", "waiting": "NOT answered_compat",
    "waiting_in_house": "NOT answered_compat AND in_house", "waiting_sent_out": "NOT answered_compat AND NOT in_house",
    "answered": "answered", "not_in_house": "NOT in_house", "same_day_reviewed": SAME_DAY, "not_same_day": f"NOT ({SAME_DAY})",
}

ORACLE = {
    "doc_review_join": f"SELECT {', '.join(LAG_COLUMNS)} FROM ({LAGS})",
    "doc_sla": f"""
SELECT reviewer_id, max(reviewer_name) AS reviewer_name, count(*) AS documents,
       count(*) FILTER (WHERE review = 1) AS reviewed, count(*) FILTER (WHERE review = 0) AS unreviewed,
       count(*) FILTER (WHERE in_time = 1) AS in_time,
       (count(*) FILTER (WHERE in_time = 1) // nullif(count(*) FILTER (WHERE review = 1), 0)) * 100 AS pct_compat,
       count(*) FILTER (WHERE in_time = 1 AND review = 1) * CAST(100 AS DOUBLE)
           / nullif(count(*) FILTER (WHERE review = 1), 0) AS pct
FROM ({LAGS}) GROUP BY reviewer_id""",
    "doc_unreviewed": f"""
SELECT reviewer_id, reviewer_name, scanned_by, custom_name, del_flag, doc_id, file_format, file_name, patient_id, review
FROM ({ASSIGNED}) WHERE review = 0""",
    "dropna_subset": f"SELECT * FROM ({LABELLED}) WHERE quality IS NOT NULL",
    "answered_split": f"""
SELECT quality IS NOT NULL AS answered, source IN ('src1', 'src2', 'src3') AS in_house, count(*) AS labs,
       count(DISTINCT doc_id) AS encounters FROM ({LABELLED}) GROUP BY 1, 2""",
    "doc_within": f"SELECT doc_id, CASE WHEN toxic <= 0 THEN 1 ELSE 0 END AS flag FROM ({LABELLED})",
    "lag_bucket_pivot": _pivot(TURNAROUND, "l_suppkey", "days"),
    "lag_elapsed": """
SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-15 12:00:00' - ts) / 86400) AS BIGINT) AS days,
       date_diff('day', CAST(ts AS DATE), DATE '2024-01-15') AS calendar_days,
       CAST(floor(s / 86400) AS BIGINT) || ' days ' || strftime(TIMESTAMP '2000-01-01' + to_seconds(s - 86400 * floor(s / 86400)), '%H:%M:%S') AS lag_text
FROM (SELECT *, epoch(TIMESTAMP '2024-01-15 12:00:00' - date_trunc('second', ts)) AS s FROM events)""",
    "lag_calendar": f"SELECT l_orderkey, l_suppkey, days FROM ({TURNAROUND})",
    "lag_histogram": f"SELECT days, count(*) AS labs FROM ({TURNAROUND}) GROUP BY 1",
    "reviewer_lag_lists": f"""
SELECT l_suppkey, {_distinct('l_returnflag', 'flags')}, {_distinct('l_linestatus', 'statuses')},
       round(avg(days), 2) AS avg_rev, count(*) AS labs FROM ({TURNAROUND}) GROUP BY 1""",
    "lab_outcomes": f"""
SELECT answered_compat, in_house, count(*) AS labs, count(DISTINCT encounter_id) AS encounters FROM ({LABS}) GROUP BY 1, 2""",
    "lab_month_slice": f"""
SELECT encounter_id, item_id, reviewed_by, assigned_to_id, orderer_id, orderer_name, coll_date, result_date, reviewed_date
FROM ({LABS}) WHERE year(result_date) = 1996 AND month(result_date) = 11""",
    "sentinel_lag": f"""
SELECT answered, answered_compat, reviewed, count(*) AS labs,
       count(*) FILTER (WHERE answered AND coll_date IS NOT NULL) AS result_lags, count(*) FILTER (WHERE reviewed) AS review_lags,
       CAST(sum(result_days) AS BIGINT) AS result_days,
       CAST(sum(CASE WHEN answered THEN review_days END) AS BIGINT) AS review_days
FROM ({LABS}) GROUP BY 1, 2, 3""",
    "lab_report_rows": f"""
SELECT encounter_id, item_id, reviewed_by,
       CASE WHEN NOT answered THEN 'Sin Resultados' ELSE {_lag_text('result_date - coll_date')} END AS result_lag,
       CASE WHEN NOT reviewed THEN 'Sin revisión' ELSE {_lag_text('reviewed_date - result_date')} END AS review_lag
FROM ({LABS})""",
    "same_day_complement": f"""
SELECT orderer_id, count(*) AS labs, CASE WHEN {SAME_DAY} THEN 'same_day' ELSE 'other' END AS half
FROM ({LABS}) GROUP BY 1, 3""",
    "lab_splits": " UNION ALL ".join(
        f"SELECT '{name}' AS split, encounter_id, item_id, assigned_to_id FROM ({LABS}) WHERE {test}" for name, test in SPLIT_TESTS.items()
    ),
    "lab_split_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS split, count(*) AS labs, count(DISTINCT encounter_id) AS encounters FROM ({LABS}) WHERE {test}"
        for name, test in SPLIT_TESTS.items()
    ),
    "reviewer_staff": f"""
SELECT DISTINCT reviewed_by, list, value FROM (SELECT reviewed_by, assigned_to_id AS assigned_to, orderer_id || '//' AS ordered_by,
    orderer_name || '//' AS orderer_names FROM ({ANSWERED})) UNPIVOT (value FOR list IN (assigned_to, ordered_by, orderer_names))""",
    "reviewer_summary_short": f"""
SELECT reviewed_by, CASE WHEN count(DISTINCT assigned_to_id) <= 3 THEN string_agg(DISTINCT assigned_to_id, ',' ORDER BY assigned_to_id) END AS assigned_to,
       CASE WHEN count(DISTINCT orderer_id) <= 3 THEN string_agg(DISTINCT orderer_id || '//', ',' ORDER BY orderer_id || '//') END AS ordered_by,
       CASE WHEN count(DISTINCT orderer_name) <= 3 THEN string_agg(DISTINCT orderer_name || '//', ',' ORDER BY orderer_name || '//') END AS orderer_names,
       round(avg(review_days), 2) AS avg_rev, count(*) AS labs FROM ({ANSWERED}) GROUP BY 1""",
    "reviewer_summary": f"""
SELECT reviewed_by, {STAFF}, round(avg(review_days), 2) AS avg_rev, count(*) AS labs FROM ({ANSWERED}) GROUP BY 1""",
    "reviewer_buckets": _pivot(ANSWERED, "reviewed_by", "review_days", STAFF + ","),
    "reviewer_bucket_detail": f"""
SELECT reviewed_by, CASE WHEN review_days <= 3 THEN 1 WHEN review_days <= 5 THEN 2 WHEN review_days <= 7 THEN 3
       WHEN review_days <= 14 THEN 4 ELSE 5 END AS bucket, {STAFF_PLAIN}, round(avg(review_days), 2) AS avg_rev, count(*) AS labs
FROM ({ANSWERED}) WHERE review_days IS NOT NULL GROUP BY 1, 2""",
    "review_histogram": f"SELECT review_days, count(*) AS labs FROM ({ANSWERED}) GROUP BY 1",
    "answered_unreviewed": f"""
SELECT encounter_id, item_id, reviewed_by, assigned_to_id FROM ({ANSWERED}) WHERE reviewed_by = '0'""",
    "pending_queue": _queue(f"SELECT * FROM ({ANSWERED}) WHERE reviewed_by = '0'"),
    "waiting_queue": _queue(WAITING),
    "encounter_summary": _encounters(ANSWERED),
    "encounter_summary_slow": _encounters(f"SELECT * FROM ({ANSWERED}) WHERE NOT ({SAME_DAY})"),
    "waiting_encounters": f"SELECT encounter_id, count(*) AS labs FROM ({WAITING}) GROUP BY 1",
}
