"""Driver tables in the shape the reports expect.

The domain is clinical, the tables are not; each function says what stands for
what. All of them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretally.operators.skew import lookup_join, salted_join


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


# --- visits and patients -----------------------------------------------------


def patients(spark: SparkSession, d: str) -> DataFrame:
    """Customer = patient; the segment stands for the date of birth."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("facility_group_id"), F.col("c_mktsegment").alias("dob")
    )


def facilities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("facility_group_id"), F.col("n_name").alias("facility_group_name")
    )


def plain_visits(spark: SparkSession, d: str) -> DataFrame:
    """Event = visit of user = patient; purchase = checked out."""
    value = F.col("value")
    return table(spark, d, "events").select(
        F.col("user_id").alias("patient_id"),
        F.col("event_id").alias("encounter_id"),
        F.to_date("ts").alias("appointment_date"),
        F.col("event_type").alias("visit_status"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("is_new_patient"),
        F.length("event_type").alias("general_visit_status_id"),
        F.when(F.get_json_object("props", "$.k") == "50", 1).otherwise(0).alias("np_flag"),
        F.when(value < 20, "short").when(value < 100, "regular").otherwise("long").alias("visit_type"),
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    return lookup_join(plain_visits(spark, d), patients(spark, d), "patient_id")


VISITS_SQL = """
SELECT e.user_id AS patient_id, e.event_id AS encounter_id, CAST(e.ts AS DATE) AS appointment_date,
       e.event_type AS visit_status,
       CASE WHEN e.event_type = 'signup' THEN 1 ELSE 0 END AS is_new_patient,
       CAST(length(e.event_type) AS INTEGER) AS general_visit_status_id,
       CASE WHEN json_extract_string(e.props, '$.k') = '50' THEN 1 ELSE 0 END AS np_flag,
       CASE WHEN e.value < 20 THEN 'short' WHEN e.value < 100 THEN 'regular' ELSE 'long' END AS visit_type,
       c.c_nationkey AS facility_group_id, c.c_mktsegment AS dob
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
"""


# --- booking log -------------------------------------------------------------


def log(spark: SparkSession, d: str) -> DataFrame:
    """Event = log entry; its type is site and reason, an error has no reason."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("patient_id"),
        F.col("event_id").alias("encounter_id"),
        F.to_date("ts").alias("appointment_date"),
        F.col("ts").alias("modify_date"),
        F.col("event_type").alias("FacilityName"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("Reason"),
        F.upper("event_type").alias("VisitStatus"),
        F.col("props").alias("Notes"),
    )


LOG_SQL = """
SELECT user_id AS patient_id, event_id AS encounter_id, CAST(ts AS DATE) AS appointment_date, ts AS modify_date,
       event_type AS FacilityName, nullif(event_type, 'error') AS Reason, upper(event_type) AS VisitStatus, props AS Notes
FROM events
"""


# --- claims and money --------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Order with its lines = claims of a patient; part = insurance. An order
    without lines has no insurance."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("claim_no"))
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_no"),
        F.to_date("l_shipdate").alias("service_date"),
        F.col("l_partkey").alias("primary_insurance_id"),
    )
    return salted_join(orders, lines, "claim_no", "left")


def insurance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("primary_insurance_id"), F.col("p_type").alias("primary_insurance_class")
    )


CLAIMS_SQL = """
SELECT o.o_custkey AS patient_id, o.o_orderkey AS claim_no, CAST(l.l_shipdate AS DATE) AS service_date,
       l.l_partkey AS primary_insurance_id, p.p_type AS primary_insurance_class
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
"""


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Each order date with a period such as ``FY98 - 7``."""
    day = F.col("o_orderdate")
    label = F.concat(F.lit("FY"), F.date_format(day, "yy"), F.lit(" - "), F.month(day).cast("string"))
    return table(spark, d, "orders").select(F.to_date(day).alias("dates"), label.alias("period")).distinct()


CALENDAR_SQL = """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS dates,
       'FY' || strftime(o_orderdate, '%y') || ' - ' || CAST(month(o_orderdate) AS VARCHAR) AS period FROM orders
"""

PERIODS = ("FY97 - 7", "FY97 - 8", "FY97 - 9", "FY97 - 10", "FY97 - 11")
# Unique at every scale; see the table notes.
LINE_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("resource_provider_name")
    )


def claims_with(spark: SparkSession, d: str) -> DataFrame:
    """Line = claim row with procedure; supplier = provider."""
    named = lookup_join(table(spark, d, "lineitem"), suppliers(spark, d), "l_suppkey")
    return named.select(
        F.col("l_orderkey").alias("claim_no"),
        F.col("l_partkey").alias("encounter_id"),
        "resource_provider_name",
        F.col("l_returnflag").alias("payer_class"),
        F.col("l_linestatus").alias("quality_level"),
        F.to_date("l_shipdate").alias("service_date"),
        *LINE_TIE,
    )


CLAIMS_WITH_SQL = """
SELECT l.l_orderkey AS claim_no, l.l_partkey AS encounter_id, s.s_name AS resource_provider_name,
       l.l_returnflag AS payer_class, l.l_linestatus AS quality_level, CAST(l.l_shipdate AS DATE) AS service_date, l.*
FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
"""


def claims_without(spark: SparkSession, d: str) -> DataFrame:
    """Order = claim; the customer's nation = provider."""
    provider = lookup_join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("n_nationkey")),
        table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("resource_provider_name")),
        "n_nationkey",
    )
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("claim_no"),
        F.col("o_orderstatus").alias("quality_level"),
        F.col("o_orderpriority").alias("visit_type_classification"),
        F.to_date("o_orderdate").alias("service_date"),
        F.col("o_totalprice").alias("billed_charge"),
        (F.col("o_totalprice").cast("decimal(18,2)") / 2).cast("decimal(18,2)").alias("payment"),
    )
    return lookup_join(orders, provider, "patient_id")


CLAIMS_WITHOUT_SQL = """
SELECT o.o_custkey AS patient_id, o.o_orderkey AS claim_no, o.o_orderstatus AS quality_level,
       o.o_orderpriority AS visit_type_classification, CAST(o.o_orderdate AS DATE) AS service_date,
       n.n_name AS resource_provider_name
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
"""


def applied_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Line = payment line; shipped = served, ordered = deposited."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_no"),
        F.col("l_partkey").alias("encounter_id"),
        F.col("l_extendedprice").alias("payment"),
        F.to_date("l_shipdate").alias("service_date"),
    )
    return lines


def deposited_revenue(spark: SparkSession, d: str) -> DataFrame:
    deposits = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_no"), F.to_date("o_orderdate").alias("deposit_date")
    )
    return salted_join(applied_revenue(spark, d), deposits, "claim_no", "left", unique_right=True)


# --- star for the scorecard --------------------------------------------------


def fact(spark: SparkSession, d: str) -> DataFrame:
    """Line = billed procedure, with the keys of all dimensions."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("resource_provider_id"),
        F.col("l_linenumber").cast("long").alias("cpt_provider_allocated_id"),
        F.col("l_partkey").alias("cpt_id"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("is_billable"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("new_patient"),
        F.col("l_extendedprice").alias("payment"),
        F.col("l_linestatus").alias("complexity_level"),
    )
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("primary_insurance_id"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("calendar_week_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("visit_type_id"),
    )
    site = table(spark, d, "customer").select(
        F.col("c_custkey").alias("primary_insurance_id"), F.col("c_nationkey").alias("facility_group_id")
    )
    return lookup_join(salted_join(lines, orders, "l_orderkey", "left", unique_right=True), site, "primary_insurance_id")


def star_dimensions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders, day = table(spark, d, "orders"), F.col("o_orderdate")
    return {
        "weeks": orders.select(
            F.date_format(day, "yyyyMMdd").cast("int").alias("calendar_week_id"),
            F.concat(F.lit("P"), F.month(day).cast("string")).alias("calendar_period"),
            F.concat(F.lit("W"), F.weekofyear(day).cast("string")).alias("calendar_week"),
            F.concat(F.lit("Y"), F.date_format(day, "yy")).alias("calendar_year"),
        ).distinct(),
        "facilities": facilities(spark, d),
        "insurance": table(spark, d, "customer").select(
            F.col("c_custkey").alias("primary_insurance_id"),
            F.col("c_mktsegment").alias("primary_insurance_class"),
            F.col("c_nationkey").cast("string").alias("primary_insurance_group"),
            F.col("c_name").alias("primary_insurance_name"),
        ),
        "providers": table(spark, d, "supplier").select(
            F.col("s_suppkey").alias("resource_provider_id"), F.col("s_name").alias("resource_provider_name")
        ),
        "visit_types": orders.select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("visit_type_id"),
            F.col("o_orderpriority").alias("visit_type"),
            F.lower("o_orderpriority").alias("visit_type_description"),
        ).distinct(),
        "cpts": table(spark, d, "part").select(
            F.col("p_partkey").alias("cpt_id"), F.col("p_type").alias("cpt_group"), F.col("p_name").alias("cpt_description")
        ),
    }


STAR_SQL = """
SELECT l.l_orderkey, l.l_suppkey AS resource_provider_id, CAST(l.l_linenumber AS BIGINT) AS cpt_provider_allocated_id,
       l.l_partkey AS cpt_id, CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_billable,
       CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END AS new_patient, l.l_extendedprice AS payment,
       l.l_linestatus AS complexity_level, o.o_custkey AS primary_insurance_id,
       CAST(strftime(o.o_orderdate, '%Y%m%d') AS INTEGER) AS calendar_week_id,
       CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS visit_type_id, c.c_nationkey AS facility_group_id,
       'P' || CAST(month(o.o_orderdate) AS VARCHAR) AS calendar_period,
       'W' || CAST(weekofyear(o.o_orderdate) AS VARCHAR) AS calendar_week,
       'Y' || strftime(o.o_orderdate, '%y') AS calendar_year,
       n.n_name AS facility_group_name, c.c_mktsegment AS primary_insurance_class,
       CAST(c.c_nationkey AS VARCHAR) AS primary_insurance_group, c.c_name AS primary_insurance_name,
       s.s_name AS resource_provider_name, a.s_name AS allocated_provider_name,
       o.o_orderpriority AS visit_type, lower(o.o_orderpriority) AS visit_type_description,
       p.p_type AS cpt_group, p.p_name AS cpt_description
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN supplier a ON a.s_suppkey = l.l_linenumber
LEFT JOIN part p ON p.p_partkey = l.l_partkey
"""


# --- documents ---------------------------------------------------------------


def scan_day() -> Column:
    return F.date_add(F.lit("2023-11-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(45)).cast("int"))


def raw_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document extract, all text. Source = reviewer, English = reviewed and listed
    twice, very long = deleted; the scan day spreads over November and December."""
    lang, number = F.col("lang"), F.regexp_replace("source", "src", "")
    listing = F.explode(F.when(lang == "en", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0))))
    return table(spark, d, "documents").withColumn("listing", listing).select(
        F.col("doc_id").cast("string").alias("docID"),
        (F.col("n_chars") + F.col("listing")).cast("string").alias("PatientId"),
        number.alias("ReviewerId"),
        F.col("source").alias("reviewername"),
        lang.alias("ScannedBy"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("customName"),
        F.lit("pdf").alias("fileformat"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(lang == "en", "1").otherwise("0").alias("Review"),
        F.when(F.col("n_chars") > 15000, "1").otherwise("0").alias("delFlag"),
        F.concat(F.date_format(scan_day(), "MMM  d yyyy"), F.lit("  9:05AM")).alias("scanDate"),
    )


def raw_report(spark: SparkSession, d: str) -> DataFrame:
    """Label = row of the external report, reviewed -1 to 9 days after the scan; good
    quality = listed again with a review three days later."""
    listing = F.explode(F.when(F.col("quality") == 1, F.array(F.lit(3), F.lit(0))).otherwise(F.array(F.lit(0))))
    reviewed = F.date_add(scan_day(), F.pmod(F.col("doc_id"), F.lit(11)).cast("int") - 1 + F.col("listing"))
    return table(spark, d, "labels").withColumn("listing", listing).select(
        F.col("doc_id").cast("string").alias("Document ID"),
        F.date_format(reviewed, "dd/MM/yyyy").alias("Reviewed Date"),
        F.col("toxic").cast("string").alias("Scanned By"),
        F.col("quality").cast("string").alias("Reviewer Name"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("Patient Acct No + Name"),
    )


# Reviewers who are providers; two of the twenty are not.
REVIEWERS = tuple(range(18))

DOCS_SQL = """
SELECT doc_id, n_chars + listing AS patient_id, CAST(replace(source, 'src', '') AS BIGINT) AS reviewer_id, source AS reviewer_name,
       lang AS scanned_by, 'doc ' || CAST(doc_id AS VARCHAR) AS custom_name, 'pdf' AS file_format,
       CAST(doc_id AS VARCHAR) || '.pdf' AS file_name, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS review,
       CASE WHEN n_chars > 15000 THEN 1 ELSE 0 END AS del_flag,
       DATE '2023-11-01' + CAST(doc_id % 45 AS INTEGER) AS scan_day
FROM (SELECT *, unnest(CASE WHEN lang = 'en' THEN [1, 0] ELSE [0] END) AS listing FROM documents)
"""
REPORT_SQL = """
SELECT doc_id, DATE '2023-11-01' + CAST(doc_id % 45 + doc_id % 11 - 1 + listing AS INTEGER) AS reviewed_date,
       CAST(toxic AS VARCHAR) AS report_scanned_by, CAST(quality AS VARCHAR) AS report_reviewer_name,
       CAST(doc_id AS VARCHAR) AS report_patient_id, CAST(quality AS VARCHAR) AS report_patient_name
FROM (SELECT *, unnest(CASE WHEN quality = 1 THEN [3, 0] ELSE [0] END) AS listing FROM labels)
"""


# --- labs --------------------------------------------------------------------


def labs(spark: SparkSession, d: str) -> DataFrame:
    """Line = lab order: collected some hours before the order date, resulted on
    it (orders of 1997: never), reviewed when shipped (returned lines: never) by
    the supplier. Untaxed lines have no collection date."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("encounter_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").cast("string").alias("reviewed_by"),
        F.col("l_linenumber").cast("string").alias("assigned_to_id"),
        F.col("l_returnflag").alias("orderer_id"),
        F.col("l_linestatus").alias("orderer_name"),
        "l_quantity",
        "l_tax",
        "l_shipdate",
    )
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id"), "o_orderdate")
    joined = salted_join(lines, dates, "encounter_id", "left", unique_right=True)
    never = F.lit("1901-01-01 00:00:00").cast("timestamp_ntz")
    hours = F.make_dt_interval(hours=F.col("l_quantity").cast("int"))
    return joined.select(
        "encounter_id",
        "item_id",
        "reviewed_by",
        "assigned_to_id",
        "orderer_id",
        "orderer_name",
        F.when(F.col("l_tax") > 0, F.col("o_orderdate") - hours).alias("coll_date"),
        F.when(F.year("o_orderdate") == 1997, never).otherwise(F.col("o_orderdate")).alias("result_date"),
        F.when(F.col("orderer_id") == "R", never).otherwise(F.col("l_shipdate")).alias("reviewed_date"),
    )


# Items counted as done in house.
IN_HOUSE = tuple(range(30))

LABS_SQL = f"""
SELECT *, CASE WHEN year(result_date) <> 1901
               THEN CAST(floor(epoch(result_date - coll_date) / 86400) AS BIGINT) END AS result_days,
       CASE WHEN year(reviewed_date) <> 1901
            THEN CAST(floor(epoch(reviewed_date - result_date) / 86400) AS BIGINT) END AS review_days,
       item_id IN {IN_HOUSE} AS in_house, year(reviewed_date) <> 1901 AS reviewed, year(result_date) <> 1901 AS answered,
       year(result_date) = 1901 OR coll_date IS NOT NULL AS answered_compat
FROM (
SELECT l.l_orderkey AS encounter_id, l.l_partkey AS item_id, CAST(l.l_suppkey AS VARCHAR) AS reviewed_by,
       CAST(l.l_linenumber AS VARCHAR) AS assigned_to_id, l.l_returnflag AS orderer_id, l.l_linestatus AS orderer_name,
       CASE WHEN l.l_tax > 0 THEN o.o_orderdate - to_hours(CAST(l.l_quantity AS INTEGER)) END AS coll_date,
       CASE WHEN year(o.o_orderdate) = 1997 THEN TIMESTAMP '1901-01-01 00:00:00' ELSE o.o_orderdate END AS result_date,
       CASE WHEN l.l_returnflag = 'R' THEN TIMESTAMP '1901-01-01 00:00:00' ELSE l.l_shipdate END AS reviewed_date
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
"""
