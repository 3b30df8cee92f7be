"""Ranked search against the plain formula."""

import math
import random
import re
from collections import Counter

import pytest

from caretally.llm import ranked

from .test_operators import SCHEMA, prose, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def plain(documents, items, top=10):
    lists = [(k, terms(t)) for k, t in documents]
    lists = [(k, w, Counter(w)) for k, w in lists if w]
    total, df = sum(len(w) for _, w, _ in lists), Counter(t for _, _, c in lists for t in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        scores = []
        for doc_id, w, tf in lists:
            m = 100 - 75 + 75 * len(w) * len(lists) // total
            s = sum(math.floor(1000 * math.log((2 * len(lists) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    some = texts() + [" ".join(r.choice(["a", "b", "c", "d", "e", "ß", "日本", "x-y", "q2"]) for _ in range(r.randrange(1, 30))) for _ in range(400)] + ["tie tie", "tie tie", "tie tie"]
    return list(enumerate(some)) + [(None, "tie tie"), (None, "a b"), (7, "tie tie")]


@pytest.mark.parametrize(("top", "terms_at_once", "bitmaps"), [(10, 500_000, 8 << 20), (3, 40, 1)])
def test_search(spark, corpus, monkeypatch, top, terms_at_once, bitmaps):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms_at_once)
    monkeypatch.setattr(ranked, "BITMAP_BYTES", bitmaps)
    items = [(1, "a b c, A-B!"), (2, "tie"), (3, prose(1, 150)), (4, None), (5, ""), (6, "?!"), (7, "absent"), (8, "日本 ß q2 x"), (1, "a b c, A-B!"), (9, prose(3, 30) + " " + prose(101, 41)), (None, "epee d"), (10, " ".join(f"w{k}" for k in range(300)) + " e")]
    frame = spark.createDataFrame([(k, t, "en", "s", 0, 7, "v", 0.5, 1) for k, t in corpus], SCHEMA).repartition(3)
    got = [tuple(x) for x in ranked.ranked(frame, spark.createDataFrame([(*x, 0.5, 3) for x in items], "item_id long, text string, score double, rank int"), top).collect()]
    assert sorted(got, key=str) == plain(corpus, items, top) and len(got) > 20
    assert ranked.ranked(frame.limit(0), spark.createDataFrame(items, "item_id long, text string"), top).collect() == []
    assert ranked.ranked(frame, spark.createDataFrame([], "item_id long, text string"), top).collect() == []


def test_masks_that_cannot_reach_the_best_are_not_evaluated(spark, corpus, monkeypatch):
    evaluated, add = [], ranked.Best.add
    monkeypatch.setattr(ranked.Best, "add", lambda self, item, score, *rest: (evaluated.append(len(score)), add(self, item, score, *rest))[1])
    import numpy as np
    import pyarrow as pa

    docs = [(k, "common " * (1 + k % 3) + (f"rare{k % 20} other" if k % 50 == 0 else "other")) for k in range(5_000)]
    block = pa.table({"item_id": [1], "text": ["common rare0 rare10 rare15 rare5"]})
    vocabulary, codes, repeats = ranked.numbered_items(block)
    best = ranked.Best(1, 10)
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "text": t} for k, t in docs])
    for doc, null, data, offsets in ranked.blocks_of([batch], 1_000):
        ranked.search_block(best, doc, null, ranked.postings(vocabulary, data, offsets), (codes, repeats), np.full(len(vocabulary), 1000), 15_000, 5_000)
    assert 0 < sum(evaluated) < 500 and len(best.found[0][0]) == 10
