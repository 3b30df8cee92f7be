"""Both ways of each skew-proof operator return the rows of a brute-force run."""

import random

import pytest
from pyspark.sql import functions as F

from caretally.operators import skew
from caretally.operators.dedup import claim_map, keep_first, keep_last, keep_values_on_edges
from caretally.operators.lists import distinct_list, ordered_list


@pytest.fixture(scope="module")
def data():
    """Key 7 holds more than a third of the rows, the null key another part."""
    rnd = random.Random(5)
    keys = [7] * 400 + [None] * 150 + [rnd.randrange(100) for _ in range(450)]
    rows = [(k, rnd.randrange(20), i, None if rnd.random() < 0.1 else rnd.randrange(-5, 50)) for i, k in enumerate(keys)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k int, day int, id int, v int").repartition(3)


def numbered(data, descending=False):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    out = []
    for rows in groups.values():
        total = None
        ordered = sorted(rows, key=lambda r: (r[1], r[2]), reverse=descending)
        for n, r in enumerate(ordered, 1):
            total = total if r[3] is None else (total or 0) + r[3]
            out.append((*r, n, total))
    return out


@pytest.mark.parametrize("group_rows", [50, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_number_rows(frame, data, as_rows, group_rows, descending):
    order = [F.desc("day"), F.desc("id")] if descending else ["day", "id"]
    got = skew.number_rows(frame, ["k"], order, running={"total": F.col("v")}, group_rows=group_rows)
    want = numbered(data, descending)
    assert got.columns == ["k", "day", "id", "v", "rn", "total"]
    assert as_rows(got) == sorted(want, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def test_number_rows_two_keys(frame, as_rows):
    keyed = frame.withColumn("k2", F.when(F.col("id") < 900, "a"))
    plain = skew.number_rows(keyed, ["k", "k2"], ["day", "id"])
    split = skew.number_rows(keyed, ["k", "k2"], ["day", "id"], group_rows=40)
    assert as_rows(plain) == as_rows(split)


def test_big_groups_are_cut(frame):
    got = skew.number_rows(frame, ["k"], ["day", "id"], group_rows=50)
    # The numbering reads a staged table whose pieces are all small.
    sizes = got.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("_piece").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert sizes.count() > 10


def test_order_is_required(frame):
    with pytest.raises(ValueError):
        skew.number_rows(frame, ["k"], [])
    with pytest.raises(ValueError):
        keep_first(frame, "k", [])


def test_hot_keys(frame):
    hot = skew.hot_keys(frame, ["k"], 100)
    sizes = {r["k"]: r["n"] for r in frame.groupBy("k").agg(F.count("*").alias("n")).collect() if r["n"] > 100}
    pieces = frame.select("k").distinct().withColumn("_h", F.xxhash64("k")).join(hot.keys, "_h").collect()
    assert {r["k"]: r["_pieces"] for r in pieces} == {k: -(-n // 100) for k, n in sizes.items()} and set(sizes) == {7, None}
    assert hot.rows == 1000
    assert not skew.hot_keys(frame, ["k"], 500)
    assert not skew.hot_keys(frame, ["k"], 1000)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("right_side", ["unique", "hot", "missing_hot"])
def test_salted_join(spark, frame, as_rows, how, right_side):
    keys = {"unique": list(range(60)), "hot": [7] * 300 + list(range(60)) * 2, "missing_hot": [3] * 300 + [90, 91]}[right_side]
    right = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, -1)] * 120, "k int, w int")
    plain = frame.join(right, "k", how)
    got = skew.salted_join(frame, right, "k", how, hot_rows=100)
    assert got.columns == plain.columns
    assert as_rows(got) == as_rows(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_left_to_aqe(spark, frame, as_rows, how):
    right = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 300 + [3] * 40 + [90])] + [(None, -1)] * 120, "k int, w int")
    plain = as_rows(frame.join(right, "k", how))
    assert skew.aqe_splits(spark)
    spark.conf.set("spark.caretally.hotRows", "100")
    try:
        assert as_rows(skew.salted_join(frame, right, "k", how)) == plain
    finally:
        spark.conf.unset("spark.caretally.hotRows")


def test_building_a_split_join_starts_no_job(spark, frame):
    spark.sparkContext.setJobGroup("building", "building")
    right = frame.groupBy("k").agg(F.min("id").alias("first"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        skew.salted_join(frame, right, "k", how, unique_right=True)
    skew.salted_join(frame, frame.select("k", "v"), "k", "inner")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_salted_join_unique_right(spark, frame, as_rows):
    right = frame.groupBy("k").agg(F.min("id").alias("first"))
    got = skew.salted_join(frame, right, "k", "left", unique_right=True, hot_rows=100)
    assert as_rows(got) == as_rows(frame.join(right, "k", "left"))


@pytest.mark.parametrize("equal_rows", [False, True])
def test_salt_spreads_a_hot_key(frame, equal_rows):
    rows = frame.select("k", *([] if equal_rows else ["id"]))
    hot = skew.hot_keys(rows, ["k"], 100)
    per_salt = skew._salted(rows, hot, ["k"], "s").where("k = 7").groupBy("s").count().collect()
    assert len(per_salt) == 5 and max(r["count"] for r in per_salt) < 160


def test_copies_are_those_of_the_own_key(spark):
    big = spark.range(1000).selectExpr("CAST(IF(id < 700, 0, 1 + id % 2) AS int) AS k")
    hot = skew.hot_keys(big, ["k"], 100)
    small = spark.createDataFrame([(0,), (1,), (2,), (3,)], "k int")
    assert {r["k"]: r["count"] for r in skew._copied(small, hot, ["k"], "s").groupBy("k").count().collect()} == {0: 7, 1: 2, 2: 2, 3: 1}


def test_salted_join_wants_one_type(spark, frame):
    with pytest.raises(ValueError):
        skew.salted_join(frame, spark.range(3).withColumnRenamed("id", "k"), "k")
    with pytest.raises(ValueError):
        skew.salted_join(frame, frame, "k", "outer")


@pytest.mark.parametrize("group_rows", [50, 100_000])
def test_ordered_list_pages(frame, data, group_rows):
    got = ordered_list(frame, ["k"], {"ids": F.col("id"), "vs": F.col("v")}, ["day", "id"], page_rows=30, first=["v"],
                       group_rows=group_rows).collect()
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    assert all(r["n"] == len(groups[r["k"]]) for r in got) and len(got) == sum(-(-len(g) // 30) for g in groups.values())
    for k, members in groups.items():
        pages = sorted((r for r in got if r["k"] == k), key=lambda r: r["page"])
        assert [p["page"] for p in pages] == list(range(len(pages)))
        assert ",".join(p["ids"] for p in pages) == ",".join(str(m[2]) for m in members)
        assert ",".join(p["vs"] for p in pages if p["vs"]) == ",".join(str(m[3]) for m in members if m[3] is not None)
        assert [p["v"] for p in pages] == [members[0][3]] * len(pages)


def test_distinct_list(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("a", None), ("b", None)], "k string, v string")
    got = {r["k"]: r["vs"] for r in distinct_list(df, ["k"], F.col("v"), "vs").collect()}
    assert got == {"a": "x,y", "b": None}


def test_keep_first_and_last(frame, data):
    for keep, pick in ((keep_first, min), (keep_last, max)):
        got = {r["k"]: r["id"] for r in keep(frame, "k", ["day", "id"]).collect()}
        want = {k: pick((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))[2] for k in {r[0] for r in data}}
        assert got == want


def test_keep_first_limits_before_the_shuffle(frame, capsys):
    keep_first(frame, "k", ["day", "id"]).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


@pytest.mark.parametrize("group_rows", [50, 100_000])
def test_keep_values_on_edges(frame, data, group_rows):
    known = frame.where("v is not null").withColumn("w", F.col("v"))
    got = keep_values_on_edges(known, ["k"], ["day", "id"], on_first=["v"], on_last=["w"], group_rows=group_rows)
    rows = [r for r in data if r[3] is not None]
    for column, pick in (("v", min), ("w", max)):
        kept = {r["k"]: r["id"] for r in got.where(f"{column} is not null").collect()}
        assert kept == {k: pick((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[2] for k in {r[0] for r in rows}}
    assert got.count() == len(rows) and got.columns == known.columns


def test_claim_map(spark, as_rows):
    df = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (2, 10, 5), (3, 11, 6)], "claim_no int, encounter_id int, patient_id int")
    assert claim_map(df, "rows").count() == 4
    assert as_rows(claim_map(df)) == [(1, 10, 5), (2, 10, 5), (3, 11, 6)]
    assert as_rows(claim_map(df, "encounter")) == [(1, 10, 5), (3, 11, 6)]
    with pytest.raises(ValueError):
        claim_map(df, "other")


def test_buckets_spare_the_shuffles(spark, frame, data):
    """Frames staged by a key are joined and grouped by it without an exchange; a frame with a hot key is left as it is."""
    staged = skew.stage_by(frame.where("k is not null"), "rows", ["k"], hot_rows=10_000_000)
    other = skew.stage_by(frame.where("k is not null").groupBy("k").agg(F.count("*").alias("n")), "counts", ["k"], hot_rows=10_000_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = staged.join(other, "k").groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = {}
        for r in data:
            if r[0] is not None:
                want[r[0]] = want.get(r[0], 0) + 1
        assert {r["k"]: (r["n"], r["rows"]) for r in joined.collect()} == {k: (n, n) for k, n in want.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("caretally_rows" in t.name for t in spark.catalog.listTables())
    assert skew.stage_by(frame, "rows", ["k"], hot_rows=5) is frame
