"""Language identification: every language, plain backoff, odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from caretally.llm import langid


def made_words(seed, n):
    r = random.Random(seed)
    letters = r.sample("abcdefghijklmnopqrstuvwxyzéèüñ", 12)
    return ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n)]


def text_of(r, words, n=25):
    return " ".join(r.choice(words) for _ in range(n)) + "."


def plain_grams(word, n):
    return [(word[i:i + n], i == 0, i + n == len(word)) for i in range(len(word) - n + 1)]


def plain(train, text):
    """(language, score) by dictionaries, all words and n-grams known."""
    words, grams = defaultdict(Counter), [None] + [defaultdict(Counter) for _ in range(4)]
    for lang, t in train:
        for w in re.findall(r"[a-zéèüñ]+", t.lower()):
            words[lang][w] += 1
            for n in range(1, 5):
                grams[n][lang].update(plain_grams(w, n))
    languages = sorted(words)

    def table(level):
        known = {k for c in level.values() for k in c}
        return known, {lang: len(known) + sum(level[lang].values()) for lang in languages}

    tables = [table(words)] + [table(grams[n]) for n in range(1, 5)]
    sums, used = dict.fromkeys(languages, 0.0), 0
    for w in re.findall(r"[a-zéèüñ]+", text.lower()):
        for level, keys, own in [(0, [w], words)] + [(n, plain_grams(w, n), grams[n]) for n in range(4, 0, -1)]:
            found = [k for k in keys if k in tables[level][0]]
            if found:
                used += 1
                for lang in languages:
                    sums[lang] += sum(math.log((own[lang][k] + 1) / tables[level][1][lang]) for k in found) / len(found)
                break
    best = min(languages, key=lambda x: (-sums[x], x))
    scale = min(1.0, 50 / max(used, 1))
    return best, 1 / sum(math.exp((sums[x] - sums[best]) * scale) for x in languages)


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_plain_backoff(spark):
    r = random.Random(1)
    known = {lang: made_words(seed, 40) for seed, lang in enumerate(["aa", "bb", "cc"])}
    rows = [(k, text_of(r, known[lang], 12) if k % 3 else text_of(r, made_words(100 + k, 8) + known[lang][:4], 9), lang) for k in range(120) for lang in [["aa", "bb", "cc"][k % 3]]]
    rows += [(1000, "Zq xyzzy KÉÉ éé", None), (1001, "same " * 3, "aa")]
    train = [(lang, t) for k, t, lang in rows if lang is not None and not held(k)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for k, t, _ in rows:
        lang, score = plain(train, t)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, rel=1e-9)


def test_every_language_is_learnt(spark):
    r = random.Random(2)
    rows, k = [], 0
    for lang in range(203):
        words = made_words(1_000 + lang, 30)
        for _ in range(8):
            rows.append((k, text_of(r, words), f"l{lang:03}"))
            k += 1
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 203
    frame = spark.createDataFrame([(a, t) for a, t, _ in rows], "doc_id long, text string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(frame, model).collect()}
    assert sum(got[a] == lang for a, _, lang in rows) > 0.97 * len(rows)


def test_a_rare_language_beside_a_large_one(spark):
    """20 documents beside 100,000 of another language, of which a bounded number is learnt from; its words are not crowded out."""
    large, rare = made_words(5, 400), made_words(6, 60)
    frame = spark.range(100_000).selectExpr("id AS doc_id", f"array({', '.join(repr(w) for w in large)}) AS w").selectExpr(
        "doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> w[pmod(xxhash64(doc_id, i), 400)])) AS text", "'big' AS lang")
    r = random.Random(3)
    few = [(1_000_000 + k, text_of(r, rare), "small") for k in range(20)]
    frame = frame.unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    counts = langid.counts_by_language(frame, sample=500)
    learnt = {x["lang"]: x["n"] for x in counts.where("length = 0").groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert learnt["small"] == 25 * sum(not held(k) for k, _, _ in few) and 12 * 300 < learnt["big"] < 12 * 800
    model = langid.fit(frame, sample=500)
    got = langid.predict(frame.where("doc_id >= 999990").drop("lang"), model).collect()
    assert {(x["doc_id"] >= 1_000_000, x["lang_pred"]) for x in got} == {(True, "small")} and len(got) == 20
    assert langid.predict(frame.where("lang = 'big'").limit(200).drop("lang"), model).where("lang_pred = 'big'").count() == 200


def test_ties_long_texts_and_clashing_columns(spark, monkeypatch):
    rows = [(k, "same words", lang) for k, lang in enumerate(["b", "a"] * 40)] + [(500, "same words " * 300_000, None), (501, "", None), (502, None, None), (None, "same", "b")]
    frame = spark.createDataFrame([(*x, 7.0, "mine", 3) for x in rows], "doc_id long, text string, lang string, score double, lang_pred string, Score2 int").where("doc_id IS NULL OR doc_id >= 500 OR doc_id % 10 < 8")
    even = frame.where("lang IS NULL OR pmod(doc_id, 10) < 8")
    got = {x["doc_id"]: x for x in langid.predictions(even).collect()}
    assert got[500]["lang_pred"] in ("a", "b") and got[501]["lang_pred"] == got[502]["lang_pred"] == "und"
    kept = langid.accepted(frame)
    assert kept.columns == frame.columns and {(x["score"], x["lang_pred"], x["Score2"]) for x in kept.collect()} == {(7.0, "mine", 3)}
    with pytest.raises(ValueError):
        langid.predict(frame, langid.fit(frame))
    monkeypatch.setattr(langid, "CELLS", 3)
    assert langid.predictions(frame.limit(0)).collect() == []
