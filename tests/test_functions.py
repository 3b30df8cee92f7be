"""Dates, text and filters on the edge rows."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caretally.functions import dates, text
from caretally.operators import filters


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").orderBy("i")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_parse_stamp(spark):
    df = column(spark, ["Nov  1 2023  9:05AM", "Nov 12 2023 11:05PM", "Jan 1 1901 12:00AM", "Nov 31 2023 9:05AM", "", None, "x"])
    assert values(df, dates.parse_stamp("c")) == [
        datetime(2023, 11, 1, 9, 5), datetime(2023, 11, 12, 23, 5), datetime(1901, 1, 1), None, None, None, None]


def test_parse_day_first(spark):
    df = column(spark, ["31/12/2023", "01/02/2023", "12/31/2023", "2023-01-01", None])
    assert values(df, dates.parse_day_first("c")) == [date(2023, 12, 31), date(2023, 2, 1), None, None, None]


def test_standard_date(spark):
    texts = ["1/5/2023 3:04 pm", "1/5/2023 03:04 AM", "01/05/2023 23:04", "01/05/2023", "13/45/2023", "1/5/2023 13:04 PM",
             "1/5/2023 3:04PM", "1/5/23", "", None]
    got = values(column(spark, texts), dates.standard_date("c"))
    assert got == ["01/05/2023"] * 4 + [None] * 6


def test_month_first_tries_the_formats_that_fit(spark):
    texts = ["1/5/2023 3:04 pm", "01/05/2023 23:04", "12/31/2023", "1/5/2023  3:04\tAm", "2/29/2024", "2/30/2024", "13/45/2023", "0/1/2023", "1/5/2023 24:00",
             "1/5/2023 13:04 PM", "1/5/2023 0:04 am", "1/5/2023 3:4", "001/05/2023", "1/5/23", "1/5/2023/4", " 1/5/2023", "12/31/2023\n", "oops", "", None]
    df = column(spark, texts)
    # What trying every format on every text gives.
    every = dates._parse(dates._one_blank("c"), "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy").cast("date")
    assert values(df, dates.parse_month_first("c")) == values(df, every)
    # Usual texts, and those no format reads, are tried by no format.
    many = spark.range(200_000).select(F.concat(F.lit("1/"), 1 + F.col("id") % 60, F.lit("/2023")).alias("c"))

    def seconds(parsed):
        start = time.monotonic()
        assert many.agg(F.count(parsed)).first()[0] == sum(i % 60 < 31 for i in range(200_000))
        return time.monotonic() - start

    seconds(dates.parse_month_first("c"))
    assert seconds(dates.parse_month_first("c")) < seconds(every) / 2


def test_or_marker(spark):
    assert values(column(spark, ["a", None]), dates.or_marker("c", dates.NO_NOTES)) == ["a", "SIN NOTES"]


def test_until_text_and_date(spark):
    df = column(spark, ["01/15/2024", "12/01/2023", "12/02/2023", "11/30/2023", None])
    assert values(df, dates.until("c", "12/01/2023", "text")) == [True, True, False, True, None]
    assert values(df, dates.until("c", "12/01/2023")) == [False, True, False, True, None]
    with pytest.raises(ValueError):
        dates.until("c", "12/01/2023", "other")


def stamps(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz").orderBy("i")


NOON, NEVER = datetime(2023, 11, 10, 12), datetime(1901, 1, 1)


def test_elapsed_and_calendar_days(spark):
    df = stamps(spark, [(NOON, datetime(2023, 11, 10, 9)), (NOON, NOON), (NOON, datetime(2023, 11, 11, 9)),
                        (NOON, datetime(2023, 11, 13, 12)), (NOON, None), (datetime(2023, 11, 10, 23, 59), datetime(2023, 11, 11, 0, 1))])
    assert values(df, dates.elapsed_days("a", "b")) == [-1, 0, 0, 3, None, 0]
    assert values(df, dates.calendar_days("a", "b")) == [0, 0, 1, 3, None, 1]


def test_elapsed_days_ignore_the_zone(spark):
    df = stamps(spark, [(datetime(2024, 3, 9, 12), datetime(2024, 3, 10, 12)), (datetime(2024, 3, 9, 12), datetime(2024, 3, 10, 11))])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        assert values(df, dates.elapsed_days("a", "b")) == [1, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_lag_and_its_text(spark):
    df = stamps(spark, [(NOON, datetime(2023, 11, 12, 14, 30, 5)), (NOON, datetime(2023, 11, 10, 9)), (NOON, NEVER), (NOON, None)])
    assert values(df, dates.lag_text(dates.lag("a", "b"))) == ["2 days 02:30:05", "-1 days 21:00:00", None, None]
    assert values(df, dates.happened("b")) == [True, True, False, None]


def test_lag_bucket(spark):
    df = column(spark, [-1, 0, 3, 4, 5, 6, 7, 8, 14, 15, None], "int")
    assert values(df, dates.lag_bucket("c")) == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, None]
    assert values(df, dates.within("c")) == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_week_bucket(spark):
    df = column(spark, [1, 7, 8, 15, 16, 23, 24, 31, None], "int")
    assert values(df, dates.week_bucket("c")) == ["S1", "S1", "S2", "S2", "S3", "S3", "S4", "S4", None]


def test_in_month_and_range_reach_the_scan(spark, tmp_path, capsys):
    df = stamps(spark, [(datetime(2023, 12, 31, 23, 59), None), (datetime(2024, 1, 1), None), (datetime(2023, 11, 30), None)])
    df.write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).where(dates.in_month("a", 2023, 12)).select("i")
    assert [r[0] for r in kept.collect()] == [0]
    kept.explain("formatted")
    assert "GreaterThanOrEqual(a,2023-12-01" in capsys.readouterr().out
    assert values(df.where(dates.in_range("a", date(2023, 11, 30), date(2023, 12, 31))), "i") == [2]


def test_new_value(spark):
    texts = ['{"A":{"OldValue":"x","NewValue":"y"},"B":{"NewValue":5}}', '{"B":{"OldValue":1}}', '{"A":{"NewValue":null}}',
             '{"A":"text","B":{"NewValue":"k"}}', '{"A":{"NewV', '{"A":{"NewValue":"k"}} junk', None, '', ' {"A":{"NewValue":true}} ',
             '{"A":{"NewValue":{"k":[1,"z"]}},"B":{"NewValue":[1.5,null]}}', '{"A":{"NewValue":"k"}},{"A":{"NewValue":"l"}}', '{"A":{"NewValue":"k"}}]', '["A"]',
             '{"a":{"NewValue":"case"}}', "{'A':{'NewValue':'quotes'}}"]
    parsed = column(spark, texts).withColumn("p", text.parsed_log("c"))
    got = [tuple(r) for r in parsed.select(text.new_value("p", "A"), text.new_value("p", "B")).collect()]
    none = (None, None)
    assert got == [("y", "5"), none, none, (None, "k"), none, none, none, none, ("true", None), ('{"k":[1,"z"]}', "[1.5,null]"), none, none, none, none, none]


def test_logs_are_parsed_once(spark, capsys):
    from caretally.plans import funnel

    log = spark.createDataFrame([(1, '{"Reason":{"NewValue":"pain"},"Notes":{"NewValue":"n"}} junk'), (2, '{"Reason":{"NewValue":"pain"}}')], "id int, log_details string")
    rows = funnel.log_with_fields(log)
    assert [(r.id, r.Reason) for r in rows.orderBy("id").collect()] == [(1, None), (2, "pain")]
    rows.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("parse_json") <= 2


def test_first_match(spark):
    df = column(spark, ["DOB: 01/02/1990 call (214) 555-0100", "call (214) 555-0100", "me@example.com", "  ", None, "none", "id 12345678"])
    assert values(df, text.first_match("c", text.DOB)) == ["01/02/1990"] + [None] * 6
    assert values(df, text.first_match("c", text.PHONE)) == ["(214) 555-0100"] * 2 + [None] * 5
    assert values(df, text.first_match("c", text.EMAIL)) == [None, None, "me@example.com", None, None, None, None]
    assert values(df, text.first_match("c", text.ID_8)) == [None] * 6 + ["12345678"]
    assert values(df, text.first_match("c", text.DOB, text.PHONE))[:2] == ["01/02/1990", "(214) 555-0100"]
    booking = column(spark, ["BookingId: 42", "BookingId:42"])
    assert values(booking, text.first_match("c", text.booking_id("BookingId"))) == ["BookingId: 42", None]


def test_split_two(spark):
    df = column(spark, ["7:Ann", "7", "7:Ann:B", None, ":x"])
    left, right = text.split_two("c")
    assert values(df, left) == ["7", "7", "7", None, ""]
    assert values(df, right) == ["Ann", None, "Ann:B", None, "x"]
    assert values(column(spark, ["a.b"]), text.split_two("c", ".")[1]) == ["b"]


def test_like_ignores_case_and_drops_nulls(spark):
    df = column(spark, ["Dummy", "xDUMMYx", "other", None])
    assert values(df.where(text.like_any_case("c", "%dummy%")), "c") == ["Dummy", "xDUMMYx"]
    assert values(df.where(text.contains_none("c", ["%dummy%"])), "c") == ["other"]


def test_is_zero(spark):
    assert values(column(spark, ["0", "00", "7", "x", "", None]), text.is_zero("c")) == [True, True, False, None, None, None]
    assert values(column(spark, [0, 7, None], "int"), text.is_zero("c")) == [True, False, None]


def test_label_in_and_not_in(spark):
    df = column(spark, ["a", "b", "c", None])
    many = [f"x{k}" for k in range(12_000)]
    for labels in (["a", "b"], ["a", "b", None], ["a", "b", *many, None]):
        assert sorted(values(filters.label_in(df, "c", labels), "c")) == ["a", "b"]
        assert values(filters.label_not_in(df, "c", labels), "c") == ["c"]
    assert values(filters.label_in(df, "c", []), "c") == [] and len(values(filters.label_not_in(df, "c", [None]), "c")) == 3


def test_labels_are_read_as_the_columns_type(spark):
    assert values(filters.label_in(column(spark, ["1", "01"]), "c", [1]), "c") == ["1"]
    assert values(filters.label_not_in(column(spark, [1, 2, None], "int"), "c", ["1"]), "c") == [2]


def test_not_both_drops_deciding_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (None, 0)], "a int, b int")
    same = (F.col("a") == 1, F.col("b") == 1)
    assert df.where(filters.both(*same)).count() == 1
    assert [tuple(r) for r in df.where(filters.not_both(*same)).collect()] == [(1, 0), (None, 0)]


def test_split_by_and_without_nulls(spark):
    df = column(spark, [1, 5, None], "int")
    assert values(filters.split_by(df, F.col("c") > 2, "big"), "big") == [False, True, None]
    assert filters.without_nulls(df, ["c"]).count() == 2
