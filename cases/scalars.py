"""Single functions and predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from caretally.functions import text
from caretally.functions.dates import in_month, in_range, or_marker, parse_day_first, parse_month_first, parse_stamp
from caretally.operators.aggs import distinct_by, repeated_keys
from caretally.operators.filters import label_in, label_not_in, not_both
from cases import tables as t


def _notes(spark, d):
    body = F.col("text")
    return t.table(spark, d, "documents").select(
        "doc_id",
        or_marker(text.first_match(body, text.EMAIL), "SIN NOTES").alias("email"),
        or_marker(text.first_match(body, text.PHONE), "SIN NOTES").alias("phone"),
        text.first_match(body, text.ID_8).alias("id_8"),
        text.first_match(body, text.DOB).alias("dob"),
        text.first_match(body, text.PHONE, text.EMAIL).alias("phone_or_email"),
    )


def _split(spark, d):
    left, right = text.split_two("o_orderpriority", "-")
    none, _ = text.split_two("o_orderstatus", "-")
    first, rest = text.split_two(F.concat_ws(":", "o_orderkey", "o_orderstatus", "o_orderpriority"), ":")
    return t.table(spark, d, "orders").select(
        "o_orderkey", left.alias("level"), right.alias("name"), none.alias("unsplit"),
        text.split_two("o_orderstatus", "-")[1].alias("missing"), first.alias("first"), rest.alias("rest"),
    )


def _parse(spark, d):
    """Each event time written as the extracts write it, and read back."""
    ts = F.col("ts")
    stamp = F.concat(F.date_format(ts, "MMM  d yyyy"), F.lit("  "), F.date_format(ts, "h:mma"))
    return t.table(spark, d, "events").select(
        "event_id",
        parse_stamp(stamp).alias("stamp"),
        parse_day_first(F.date_format(ts, "dd/MM/yyyy")).alias("day_first"),
        parse_month_first(F.date_format(ts, "M/d/yyyy h:mm a")).alias("month_first"),
        parse_stamp(F.col("event_type")).alias("bad"),
    )


def _predicates(spark, d):
    events = t.table(spark, d, "events")
    rows = label_in(events, "event_type", ("signup", "purchase", "click")).where(F.col("event_type") != "click")
    return rows.select("event_id", "event_type")


def _likes(spark, d):
    name = F.col("p_name")
    rows = t.table(spark, d, "part").where(
        text.like_any_case(name, "%RING%") | (text.like_any_case(name, "Hot%") & text.contains_none(name, ["%gear%", "%BOLT"]))
    )
    return rows.select("p_partkey", "p_name")


def _not_in(spark, d):
    rows = label_not_in(t.table(spark, d, "orders"), "o_orderstatus", ("F", "P"))
    return rows.where(not_both(F.col("o_totalprice") > 100000, F.col("o_orderpriority") == "5-LOW")).select(
        "o_orderkey", "o_totalprice", "o_orderpriority"
    )


def _scalars(spark, d):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return t.table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").cast("string").alias("date_text"),
        F.concat(status, F.lit("//"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("joined"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(0).alias("code"),
        F.coalesce(F.when(status == "P", price), F.lit(0.0)).alias("pending"),
        F.expr("o_orderkey div nullif(o_custkey, 0)").alias("whole"),
        F.round(price.cast("decimal(18,2)"), 0).cast("double").alias("rounded"),
        (F.col("o_custkey").cast("double") / F.nullif(key, F.lit(0))).alias("ratio"),
        F.nullif(status, F.lit("P")).alias("blank_to_null"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        text.is_zero(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("zero"),
        F.lit("CLINIC").alias("location"),
    )


QUERIES = {
    "notes_extract": _notes,
    "split_two": _split,
    "parse_dates": _parse,
    "month_slice": lambda s, d: t.table(s, d, "events").where(in_month("ts", 2024, 1)).select("event_id", "ts"),
    "day_window": lambda s, d: t.table(s, d, "lineitem").where(
        in_range("l_shipdate", date(1998, 1, 1), date(1998, 1, 10))
    ).select("l_orderkey", "l_shipdate"),
    "predicate_mix": _predicates,
    "like_mix": _likes,
    "not_in_mix": _not_in,
    "scalar_mix": _scalars,
    "distinct_users": lambda s, d: distinct_by(t.table(s, d, "events"), ["event_type"], "user_id", "users"),
    "repeated_keys": lambda s, d: repeated_keys(t.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
}


def _found(pattern, group=0):
    return f"CASE WHEN trim(text) <> '' THEN nullif(regexp_extract(text, '{pattern}', {group}), '') END"


EMAIL, PHONE = _found(r"\S+@\S+"), _found(r"\(\d{3}\)\s\d{3}-\d{4}")

ORACLE = {
    "notes_extract": rf"""
SELECT doc_id, coalesce({EMAIL}, 'SIN NOTES') AS email, coalesce({PHONE}, 'SIN NOTES') AS phone,
       {_found(r'\d{8}')} AS id_8, {_found(r'DOB: (\d{2}/\d{2}/\d{4})', 1)} AS dob,
       coalesce({PHONE}, {EMAIL}) AS phone_or_email FROM documents""",
    "split_two": """
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS name,
       o_orderstatus AS unsplit, CAST(NULL AS VARCHAR) AS missing, CAST(o_orderkey AS VARCHAR) AS first,
       o_orderstatus || ':' || o_orderpriority AS rest FROM orders""",
    "parse_dates": """
SELECT event_id, date_trunc('minute', ts) AS stamp, CAST(ts AS DATE) AS day_first, CAST(ts AS DATE) AS month_first,
       CAST(NULL AS TIMESTAMP) AS bad FROM events""",
    "month_slice": "SELECT event_id, ts FROM events WHERE year(ts) = 2024 AND month(ts) = 1",
    "day_window": "SELECT l_orderkey, l_shipdate FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') LIKE '%1998-01-0%'",
    "predicate_mix": "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')",
    "like_mix": """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR (p_name ILIKE 'Hot%' AND p_name NOT ILIKE '%gear%'
    AND p_name NOT ILIKE '%BOLT')""",
    "not_in_mix": """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus NOT IN ('F', 'P')
    AND NOT (o_totalprice > 100000 AND o_orderpriority = '5-LOW')""",
    "scalar_mix": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_text,
       o_orderstatus || '//' || nullif(o_orderpriority, '5-LOW') AS joined,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code,
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS pending,
       o_orderkey // nullif(o_custkey, 0) AS whole,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS DOUBLE) AS rounded,
       CAST(o_custkey AS DOUBLE) / nullif(o_orderkey, 0) AS ratio, nullif(o_orderstatus, 'P') AS blank_to_null,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, o_custkey = 0 AS zero, 'CLINIC' AS location FROM orders""",
    "distinct_users": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
}
