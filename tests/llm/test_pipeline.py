"""The whole pipeline, stage by stage, against brute force."""

import random

import pytest

import corpus_pipeline
from caretally.llm import langid, store

from .test_neardup import roots
from .test_operators import crc, ids_of, prose, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, d1 int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, texts = random.Random(1), {}
    for k in range(60):
        texts[k] = prose(300 + k, r.randrange(40, 90))
    passage, item = prose(901, 60), prose(902, 25)
    for k in (3, 9, 17):
        texts[k] += "\n" + passage + "\n" + prose(950 + k, 20)
    texts[20], texts[21] = texts[4], texts[4].replace(" ", "  ", 1)  # copies
    texts[30] = texts[31] + " " + item + " " + prose(960, 30)
    texts[31] = prose(961, 50)
    texts |= {100: None, 101: "", 102: "12 34 !!", 103: prose(970, 5_000)}
    rows = [(k, t, "en", "s", len(t or ""), 0.5, "mine", 1) for k, t in texts.items()] + [(None, prose(971, 50), None, None, 0, None, None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(999, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    def texts(frame):
        return {x["doc_id"]: x["text"] for x in frame.collect()}

    model = langid.fit(docs)
    pred = {x["doc_id"]: x for x in langid.predict(docs.select("doc_id", "text"), model).collect()}
    before, one = texts(docs), store.table(stages[0](spark, docs, corpus))
    assert one.columns == columns and texts(one) == {k: t for k, t in before.items() if pred[k]["lang_pred"] != "und" and pred[k]["score"] >= langid.MIN_SCORE}
    assert {(x["score"], x["lang_pred"], x["d1"]) for x in one.where("doc_id IS NOT NULL").collect()} == {(0.5, "mine", 1)}

    first, two = texts(one), store.table(stages[1](spark, one, corpus))
    groups = roots({k: shingles(t) for k, t in first.items() if k is not None})
    assert two.columns == columns and texts(two) == {k: t for k, t in first.items() if k is None or groups[k] == k}
    assert {20, 21}.isdisjoint(texts(two))

    seen, cleaned = set(), {}
    second, three = texts(two), store.table(stages[2](spark, two, corpus))
    for k, t in sorted(second.items(), key=lambda x: (x[0] is not None, x[0])):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        cleaned[k] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")
    assert three.columns == columns and texts(three) == cleaned and cleaned != second
    assert all(x["n_chars"] == len(x["text"]) for x in three.collect())

    item = {x["item_id"]: x["text"] for x in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()}[1]
    third, four = texts(three), store.table(stages[3](spark, three, corpus))
    leaks = {k for k, t in third.items() if 100 * len(shingles(item) & shingles(t)) >= 75 * len(shingles(item))}
    assert four.columns == columns and texts(four) == {k: t for k, t in third.items() if k not in leaks} and leaks == {30}

    fourth = texts(four)
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {x["doc_id"] for x in pieces} == set(fourth)
    for k, t in fourth.items():
        ids, at = ids_of(t), 0
        for x in sorted((x for x in pieces if x["doc_id"] == k), key=lambda x: x["piece"]):
            assert x["start"] == at and x["ids_crc32"] == crc(ids[at:at + x["length"]])
            at += x["length"]
        assert at == len(ids)
    assert all(words(t) for t in fourth.values())


def test_empty_documents(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
