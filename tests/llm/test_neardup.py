"""Near duplicates: recall at the threshold, templates, and rows with repeated or missing ids."""

import random

from pyspark.sql import functions as F

from caretally.llm import neardup

from .test_operators import prose, shingles


def roots(sets):
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_links_at_the_threshold(spark):
    """Pairs with similarities all around three quarters, of many sizes: none is lost, none is made up."""
    r, data = random.Random(8), {}
    for k in range(120):
        base = [f"b{k}w{i}" for i in range(r.randrange(6, 260))]
        cut = max(1, round(len(base) * r.uniform(0.72, 0.9)))
        data[2 * k], data[2 * k + 1] = " ".join(base), " ".join(base[:cut] + [f"n{k}x{i}" for i in range(r.randrange(0, 4))])
    sets = {k: shingles(t) for k, t in data.items()}
    got = {x["doc_id"]: x["component_id"] for x in neardup.classified(spark.createDataFrame(list(data.items()), "doc_id long, text string")).collect()}
    want = roots(sets)
    assert got == want and 10 < sum(k != v for k, v in want.items()) < 115


def test_pages_of_one_template_do_not_all_meet(spark):
    """Pages that share 160 of 206 words are less similar than the threshold and meet nobody in the last step."""
    common = [f"t{i}" for i in range(160)]
    rows = [(k, " ".join(common + [f"own{k}x{i}" for i in range(46)])) for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = neardup.measured(frame, whole=True).select("doc_id", "hashes")
    rest = neardup.measured(frame, whole=True).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    assert neardup.remaining(rest, sets).count() == 0
    assert neardup.classified(frame).where("doc_id != component_id").count() == 0
    # Pages that are similar enough beside them are still found.
    more = rows + [(1_001, " ".join(common[:150])), (1_002, rows[7][1] + " tail")]
    got = {x["doc_id"]: x["component_id"] for x in neardup.classified(spark.createDataFrame(more, frame.schema)).collect()}
    assert {k: v for k, v in got.items() if k != v} == {1_002: 7}


def test_rows_with_repeated_and_missing_ids(spark):
    a, b, c, d = (prose(s, 40) for s in (1, 2, 3, 4))
    rows = [(1, a), (5, a), (5, b), (5, "".join(x.upper() if x.isascii() else x for x in b)), (7, c), (7, c), (7, d), (None, a), (None, "only " + prose(9, 30)), (None, "only " + prose(9, 30)), (None, ""), (None, None), (8, ""), (8, None), (9, " ")]
    frame = spark.createDataFrame([(k, t, n, "x", 0.5) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n_shingles int, d1 string, kept double").repartition(3)
    got = neardup.deduplicated(frame)
    assert got.columns == frame.columns
    kept = sorted(((x["doc_id"], (x["text"] or "").strip().lower()) for x in got.collect()), key=str)
    assert kept == sorted([(1, a.lower()), (5, b.lower()), (7, c.lower()), (7, d.lower()), (None, "only " + prose(9, 30).lower()), (None, ""), (None, ""), (8, ""), (9, "")], key=str)
    assert all(rows[x["n_shingles"]][0] == x["doc_id"] and x["d1"] == "x" for x in got.collect())
