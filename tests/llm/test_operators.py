"""Every operator against a brute-force version, on rows with nulls, empty, long, tied and repeated texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from caretally.llm import decontam, huffman, langid, neardup, packing, quality, suffix, tokens, toxicity, urls, warc

WORDS = ["alpha", "Beta", "gamma", "delta", "épée", "zeta", "eta", "theta", "iota", "kappa", "straße", "mu", "nu,", "xi.", "pi"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, value string, score double, count long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.7 else "") for _ in range(n))


def texts():
    base, passage = prose(1, 150), prose(2, 60)
    near = base.split(" ")
    near[70] = "changed"
    out = [None, "", "   \n\t ", "one", "one two", base, base, " ".join(near), prose(3, 30) + "\n" + passage + "\n" + prose(4, 30), passage, prose(5, 20) + " " + passage,
           prose(6, 20_000), "aaaa " * 300, "x" * 5_000, "line\nline\n\nline\nother", "12345 !!! ...", "日本語のテキスト " * 20, "\u00a0 \u2003 it's   <|endoftext|>\n\n x"]
    return out + [prose(100 + k, 40 + k) for k in range(30)]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en" if k % 2 else "de", "s", 0, 7, "v", 0.5, 1) for k, t in enumerate(texts())]
    return out + [(None, "no id here at all, my friend", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(documents, rows, nothing):
    got = {r["doc_id"]: r for r in huffman.round_trip(documents, with_ids=True).collect()}
    start = 0
    for k, text in sorted([(r[0], r[1]) for r in rows], key=lambda x: (x[0] is not None, x[0])):
        want = ids_of(text)
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"], got[k]["ids"]) == (start, len(want), crc(want), want)
        start += len(want)
    assert huffman.round_trip(nothing).collect() == []


def test_code_is_limited_and_prefix_free():
    counts = {i: 2 ** min(i, 40) for i in range(40)} | {1000: 1}
    lengths = huffman.code_lengths(counts, 12)
    used = lengths[lengths > 0]
    assert used.max() <= 12 and len(used) == 41 and abs(sum(2.0 ** -int(x) for x in used) - 1) < 1e-12
    assert huffman.code_lengths({5: 3})[5] == 1 and len(huffman.code_lengths({})) == 0
    with pytest.raises(ValueError):
        list(huffman.read_file(np.frombuffer(b"not a file" * 20, np.uint8)))


def test_packing(documents, rows, nothing):
    got = packing.packed(documents, with_ids=True).collect()
    for k, text in ((r[0], r[1]) for r in rows):
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        want, at = ids_of(text), 0
        for n, r in enumerate(own):
            part = want[at:at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, crc(part)) and np.frombuffer(r["ids"], "<u4").tolist() == part and (n == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(want)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 1024) + 2
    assert packing.packed(nothing).collect() == []


def test_two_smaller_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = 1, 2, 0
    assert packing.filled(counts) == [7, 2]
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 21, 19]] = 1
    assert packing.filled(counts) == [60, 21, 19]


def test_equal_rows_are_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    frame = spark.createDataFrame([(None, "same words")] * 3_000 + [(k, "other") for k in range(200)], "doc_id long, text string")
    assert packing.pieces_of(frame, tokens.tokenizer_path(), 8, False).select("deal").distinct().count() > 500
    got = packing.packed(frame, length=8).collect()
    ends = {(r["sequence_id"], r["offset"] + r["length"]) for r in got}
    assert len(got) == 3_200 == len({(r["sequence_id"], r["offset"]) for r in got}) and all(r["offset"] == 0 or (r["sequence_id"], r["offset"]) in ends for r in got)


def test_suffix_array(documents, rows, nothing):
    seen, want = set(), {}
    for k, text in sorted([(r[0], r[1]) for r in rows], key=lambda x: (x[0] is not None, x[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want[k] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffix.deduplicated(documents).collect()}
    assert got == want
    cleaned = suffix.cleaned(documents)
    assert cleaned.columns == documents.columns and cleaned.count() == len(rows)
    assert suffix.deduplicated(nothing).collect() == []


def test_rows_with_equal_ids_are_ordered_by_text(spark):
    text = prose(9, 60)
    frame = spark.createDataFrame([(1, text), (1, text), (1, text + " tail"), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"] > 0) for r in suffix.deduplicated(frame).collect())
    assert got.count((2, True)) == 1 and sum(x[1] for x in got) >= 2


def test_equal_rows_are_one_document(spark):
    text, twice, long = prose(9, 60), prose(10, 60), prose(12, 20_000)
    frame = spark.createDataFrame([(1, text), (1, text), (None, twice), (None, twice), (None, twice), (2, "x " + text), (3, twice), (4, long), (4, long), (5, None), (5, ""), (5, None)], "doc_id long, text string").repartition(3)
    whole = {1: text, None: twice, 4: long, 5: "", 2: "x ", 3: ""}
    want = {k: (len((t + (text if k == 2 else twice if k == 3 else "")).encode()) - len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for k, t in whole.items()}
    got = [(r["doc_id"], (r["n_removed"], r["kept_sha256"])) for r in suffix.deduplicated(frame).collect()]
    assert len(got) == 12 and all(x == want[k] for k, x in got)


def test_multikey_order():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 3, 100_000), r.integers(0, 50, 100_000), r.integers(0, 1 << 40, 100_000)]
    order = suffix.multikey_order(columns)
    assert all((columns[k][order] == columns[k][np.lexsort(columns[::-1])]).all() for k in range(3))


def test_near_duplicates(spark, documents, rows, nothing):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["doc_id"]: r for r in neardup.classified(documents).collect()}
    assert {k: (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) for k in sets} == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}
    assert neardup.deduplicated(documents).count() == len(set(root.values())) + 1
    assert neardup.classified(nothing).collect() == []


def test_large_group_of_near_copies_is_one_component(spark):
    base, r = prose(11, 200).split(" "), random.Random(3)
    copies = []
    for k in range(300):
        text = list(base)
        for _ in range(3):
            text[r.randrange(200)] = f"w{k}"
        copies.append((k, " ".join(text)))
    frame = spark.createDataFrame(copies, "doc_id long, text string")
    assert {x["component_id"] for x in neardup.classified(frame).collect()} == {0}


def test_decontamination(spark, documents, rows, nothing):
    items = [(1, prose(2, 60)), (2, " ".join(prose(1, 150).split(" ")[20:60])), (3, prose(77, 30)), (4, None), (5, ""), (6, "one two"), (None, prose(2, 60)), (1, prose(2, 60))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, text in ((r[0], r[1]) for r in rows):
        w = [x.lower() for x in words(text)]
        for item, t in items:
            if item is None or not shingles(t):
                continue
            n = min(5, len(words(t)))
            grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
            shared = len(shingles(t) & grams)
            if 100 * shared >= 75 * len(shingles(t)):
                want.add((k, item, shared, len(shingles(t))))
    got = decontam.contaminated(documents, benchmark).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) > 5
    assert decontam.clean(documents, benchmark).count() == len(rows) - len({x[0] for x in want})
    assert decontam.contaminated(nothing, benchmark).collect() == [] and decontam.contaminated(documents, benchmark.limit(0)).collect() == []


def test_decontamination_in_blocks(spark, documents, monkeypatch):
    items = spark.createDataFrame([(k, prose(100 + k, 40 + k)) for k in range(12)] + [(50, prose(2, 60)), (51, prose(500, 20))], "item_id long, text string")
    want = sorted(map(tuple, decontam.contaminated(documents, items).collect()), key=str)
    left = documents.count() - len({x[0] for x in want})
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 100)
    assert len(list(decontam.indexes(items))) > 3
    assert sorted(map(tuple, decontam.contaminated(documents, items).collect()), key=str) == want and len(want) > 10
    assert decontam.clean(documents, items).count() == left


def test_quality(spark, documents, rows, nothing):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20, 40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(documents, labels).collect()}
    for k, text in ((r[0], r[1]) for r in rows):
        w, text = words(text), text or ""
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 1000 else set()
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        r = got[k]
        assert tuple(r)[1:5] == want
        if len(w) < 1000:
            assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(nothing, labels).collect() == [] and quality.judge(documents, labels.limit(0)).count() == len(rows)


def test_every_trusted_document_counts(spark):
    frame = spark.createDataFrame([(k, f"word{k} and more") for k in range(50)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality")
    raw, target = quality.bucket_counts(frame, labels.union(labels), quality.BUCKETS)
    assert (target.sum(), raw.sum()) == (250, 253)


@pytest.mark.parametrize(("bits", "ids", "load"), [(32, 4_000_000, 4_000), (1, 40, 1)])
def test_quality_scores(spark, documents, rows, monkeypatch, bits, ids, load):
    """Score and verdict by the plain formula; with filters that let many wrong ids through, and in blocks."""
    from collections import Counter
    from math import log

    monkeypatch.setattr(quality, "FILTER_BITS", bits)
    monkeypatch.setattr(quality, "FILTER_IDS", ids)
    monkeypatch.setattr(quality, "LOAD", load)
    good = {*range(10, 40), *range(1_000, 1_100), 12_345}
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(k, 0, 0) for k in range(10)] + [(None, 1, 0), (20, 1, 0)], "doc_id long, quality int, toxic int")
    extra = [(k, f"w{k % 7} x{k % 5} y{k % 3} common words", "en", "s", 0, 7, "v", 0.5, 1) for k in range(1_000, 1_300)]
    frame, every = documents.unionByName(spark.createDataFrame(extra, SCHEMA)), rows + extra
    buckets = quality.bucket_number(frame)
    assert buckets == max(10_000, sum(len((r[1] or "").encode()) for r in every) // load)

    import pyarrow as pa

    def grams(text):
        _, _, data, offsets = next(quality.text_blocks(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text"))
        return quality.features(data, offsets, buckets)[0].tolist()

    bags = [(r[0], Counter(grams(r[1] or ""))) for r in every]
    raw, target = Counter(), Counter()
    for k, bag in bags:
        raw += bag
        target += bag if k in good else Counter()
    want = []
    for (k, bag), r in zip(bags, every, strict=True):
        n = sum(bag.values())
        ratio = sum(c * (log((target[b] + 1) / (target.total() + buckets)) - log((raw[b] + 1) / (raw.total() + buckets))) for b, c in bag.items())
        w = words(r[1])
        assert n == 2 * len(w) - (len(w) > 0)
        want.append((k, len(w), ratio / (n + quality.SMOOTH)))
    got = quality.judge(frame, labels).collect()

    def key(x):
        return (x[0] is not None, x[0], x[1])

    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g["score"] == pytest.approx(w[2], abs=1e-9) and g["kept"] == (not g["base_failed"] and w[2] >= quality.MIN_SCORE)


def test_language(spark, nothing):
    en, de = "the house and the garden of a small town", "das haus und der garten einer kleinen stadt"
    frame = spark.createDataFrame([(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(200)] + [(200, None, "en"), (201, "12 !?", "de"), (202, "gardening thee", None), (None, "kleinerer stadtgarten", None)],
                                  "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predictions(frame).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") and 0.5 < got[k]["score"] <= 1 for k in range(200))
    assert [got[k]["lang_pred"] for k in (200, 201, 202, None)] == ["und", "und", "en", "de"] and got[200]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    assert langid.predictions(nothing).collect() == []
    assert {r["lang_pred"] for r in langid.predictions(frame.withColumn("lang", frame.lang.substr(1, 0))).collect()} <= {"", "und"}
    assert langid.accepted(frame).columns == frame.columns and langid.accepted(frame).count() == 202


def test_toxicity(spark, nothing):
    r = random.Random(5)
    data, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = prose(500 + k, 40).split(" ")
        for _ in range(3 if toxic else 0):
            text.insert(r.randrange(40), r.choice(["scumbag", "moronic", "worthless"]))
        data.append((k, " ".join(text)))
        labels.append((k, int(toxic), 1))
    data += [(1000, None), (1001, ""), (1002, "you sc.um-bag mo_ronic w o r t h l e s s"), (None, "x" * 100_000), (0, "again")]
    frame, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.scored(frame, known).collect()
    held = [(x["doc_id"], x["predicted"]) for x in got if x["held_out"] and x["doc_id"] is not None and 0 < x["doc_id"] < 400]
    assert len(got) == len(data) and np.mean([p == (k % 4 == 0) for k, p in held]) > 0.9
    assert next(x for x in got if x["doc_id"] == 1002)["predicted"] == 1 and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.scored(nothing, known).collect() == [] and {x["score"] for x in toxicity.scored(frame, known.limit(0)).collect()} == {0.0}


def test_toxic_phrases_and_broken_insults(spark):
    r, data, labels = random.Random(6), [], []
    for k in range(600):
        text = [r.choice(["drop", "dead", "you", "house", "garden", "table", "window", "river"]) for _ in range(30)]
        text = [w for i, w in enumerate(text) if i == 0 or (text[i - 1], w) != ("drop", "dead")]
        if k % 4 == 0:
            text[10:10] = ["drop", "dead"]
        text = re.sub("drop dead" if k % 4 else "$^", "drop house dead", " ".join(text))
        data.append((k, text))
        labels.append((k, int(k % 4 == 0)))
    schema = "doc_id long, text string"
    got = toxicity.scored(spark.createDataFrame(data, schema), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(x["predicted"] == 1, x["doc_id"] % 4 == 0) for x in got if x["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.9
    data = [(k, prose(500 + k, 40) + (" scumbag" if k % 4 == 0 else "")) for k in range(400)] + [(1000, "a sc um bag here"), (1001, "a house here")]
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(spark.createDataFrame(data, schema), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")).collect()}
    assert got[1000] > 0.5 > got[1001]


def test_urls(spark):
    rules = (*urls.RULES, ("block", "example.org/*/private"), ("allow", "com/a"))
    cases = {"https://www.Example.NET/x": "net/", "http://example.net/en/1?q": "example.net/en/", "http://a.example.com/de/3#x": "example.com/de/", "http://xexample.com/de/": None, "http://example.org/fr/": "org/fr/",
             "http://example.net": None, "nothing": None, "": None, None: None, "ftp://example.org/u/private": "example.org/*/private", "http://x.com/abc": "com/a", "a://b://c.net/": None, "://net/": "net/"}
    frame = spark.createDataFrame([(k, u, "z") for k, u in enumerate(cases)] + [(None, "http://a.net/", "z"), (0, "https://www.Example.NET/x", "z")], "page_id long, url string, rule string")
    got = urls.judge_urls(frame, rules=rules).collect()
    assert len(got) == len(cases) + 2
    assert {r["page_id"]: r["rule"] for r in got if r["page_id"] is not None} == dict(enumerate(cases.values()))
    first = next(r for r in got if r["page_id"] == 0)
    assert (first["host"], first["path"], first["verdict"]) == ("www.example.net", "/x", "block") and urls.judge_urls(frame.limit(0)).collect() == []


def test_warc(spark):
    page = "<p>" + prose(8, 60)
    data = [(5, "http://a/\r\nX: y", page), (3, "http://b/", page), (9, None, page), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", page), (10, "u", prose(9, 30_000))]
    frame = spark.createDataFrame([(*d, "z") for d in data], "page_id long, url string, html string, first string")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(frame)).collect()}
    for k, _, html in data:
        raw, shared = (html or "").encode(), html == page and k != 3
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if shared else "response", 3 if shared else None)
        assert r["payload"] == (None if shared else raw)
    assert warc.round_trip(frame.limit(0)).collect() == []
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parsed(good)["payload"] == b"abc"
    for broken in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/1.0"), good + b"x", good.replace(b"WARC-Date: ", b"WARC-Date:")):
        with pytest.raises(ValueError):
            warc.parsed(broken)


def test_archives_with_a_dictionary(spark):
    frame = spark.createDataFrame([(k, f"http://a/{k}", f"<html><title>{prose(k, 5)}</title>{prose(k, 80)}</html>") for k in range(200)], "page_id long, url string, html string")
    assert len(warc.dictionary(frame)) > 1000
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(warc.write_archives(frame)).collect()} == {r["page_id"]: r["html"] for r in frame.collect()}


def thue_morse(n=11):
    """Two different texts of 2 ** n letters that polynomials modulo 2 ** 64 cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_that_collide_in_weak_hashes(spark):
    x, y = thue_morse()
    frame = spark.createDataFrame([(1, x), (2, y), (3, f"{x}\n{y}"), (4, x)], "doc_id long, text string").coalesce(1)
    wanted = {1: x, 2: y, 3: f"{x}\n{y}", 4: x}
    assert {r["doc_id"]: r["ids_crc32"] for r in huffman.round_trip(frame).collect()} == {k: crc(ids_of(t)) for k, t in wanted.items()}
    assert all(r["ids_crc32"] == crc(ids_of(wanted[r["doc_id"]])[r["start"]:r["start"] + r["length"]]) for r in packing.packed(frame).collect())
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(frame, frame.selectExpr("doc_id", "1 AS quality")).collect()} == dict.fromkeys(wanted, 0)
    assert {r["doc_id"]: r["component_id"] for r in neardup.classified(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r["doc_id"]: r["n_removed"] for r in suffix.deduplicated(frame).collect()}[4] == len(x)
