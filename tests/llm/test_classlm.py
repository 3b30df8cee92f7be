"""Class-based language model: exact counts, proper probabilities, and clusters that follow the contexts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from caretally.llm import classlm

from .test_operators import SCHEMA, texts, words


def folded(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def sentence(r):
    """Words of three kinds that follow each other in a fixed order."""
    kinds = ([f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)], [f"a{k}" for k in range(12)])
    return " ".join(r.choice(kinds[k % 3]) for k in range(3 * r.randrange(3, 9)))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    some = [*texts(), *(sentence(r) for _ in range(300)), " ".join(r.choice("nva") + str(r.randrange(12)) for _ in range(60))]
    rows = [(k, t, "en", "s", 0, 7, "v", 0.5, 1) for k, t in enumerate(some)] + [(None, "n1 v1 a1 unheard", None, None, None, None, None, None, None), (3, "n1 v1 a1", "en", "s", 0, 7, "v", 0.5, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_counts_and_base_scores(spark, corpus):
    rows, frame = corpus
    train = Counter(t for k, text, *_ in rows if not held(k) for t in [*folded(text), None])
    total, kinds = sum(train.values()), len(train)
    got = classlm.scored(frame).collect()
    assert len(got) == len(rows)
    want = []
    for k, text, *_ in rows:
        line = [*folded(text), None]
        want.append((k, held(k), len(line), sum(t in train for t in line), total, sum(math.log10((train[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in line)))
    def key(x):
        return (x[0] is not None, x[0], x[2])

    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0
        assert g[7] == pytest.approx(10 ** (-g[6] / g[2]))


def test_scores_are_the_models(spark, corpus):
    """The score by the plain formula from the model's classes and the plain class bigrams; probabilities sum to 1."""
    rows, frame = corpus
    train = [folded(text) for k, text, *_ in rows if not held(k)]
    model = classlm.fit(frame.where(~classlm.held_out(frame.doc_id)), classes=5, sweeps=4)
    count = Counter(w for line in train for w in line)
    names = {}
    import pyarrow as pa

    from caretally.llm.blocks import text_blocks, word_hashes
    for w in count:
        _, _, data, offsets = next(text_blocks(pa.RecordBatch.from_arrays([pa.array([w])], ["text"]), "text"))
        names[w] = int(model.words.numbers(word_hashes(data, offsets)[0].view(np.int64))[0])
    assert {w for w, n in names.items() if n != classlm.OTHER} == {w for w, n in count.items() if n > 1}
    cls = {w: int(model.classes[n]) for w, n in names.items()}
    lines = [[0, *(cls[w] for w in line), 0] for line in train]
    bigrams = Counter(pair for line in lines for pair in zip(line, line[1:], strict=False))
    assert {(a, b): n for (a, b), n in np.ndenumerate(model.bigrams) if n} == bigrams
    size = Counter()
    for w, n in count.items():
        size[cls[w]] += n
    rare = [n for w, n in count.items() if cls[w] == classlm.OTHER]
    tail = sum(rare) + 0.5 * (len(rare) + 1)
    transition = 10 ** model.transitions()
    used = [c for c in range(len(transition)) if c in (0, 1) or c in size]
    for a in used:
        inside = {c: 1.0 if c == 0 else (sum(n + 0.5 for n in rare) + 0.5) / tail if c == 1 else sum(n for w, n in count.items() if cls[w] == c) / size[c] for c in used}
        assert sum(transition[a, c] * inside[c] for c in used) == pytest.approx(1)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in classlm.score(frame, model).collect()}
    for k, text, *_ in rows:
        before, want = 0, 0.0
        for w in [*folded(text), None]:
            c = 0 if w is None else cls.get(w, classlm.OTHER)
            share = 1.0 if w is None else (count[w] + 0.5) / tail if c == classlm.OTHER else count[w] / size[c]
            want, before = want + math.log10(transition[before, c] * share), c
        assert got[k, len(folded(text)) + 1] == pytest.approx(want, rel=1e-9)


def likelihood(bigrams):
    def part(x):
        return float((x[x > 0] * np.log(x[x > 0])).sum())

    return part(bigrams) - part(bigrams.sum(0)) - part(bigrams.sum(1))


def test_exchange_finds_the_classes(spark):
    r = random.Random(3)
    frame = spark.createDataFrame([(k, sentence(r)) for k in range(600)], "doc_id long, text string")
    start, model = classlm.fit(frame, classes=3, sweeps=0), classlm.fit(frame, classes=3, sweeps=8)
    assert likelihood(model.bigrams) > likelihood(start.bigrams)
    # Words of a kind share a class, and the kinds follow each other.
    kinds = model.bigrams[2:, 2:]
    assert (kinds > 0).sum() == 3 and sorted(np.bincount(model.classes)[2:]) == [12, 12, 12]
    odd = spark.createDataFrame([(1, sentence(random.Random(9))), (2, " ".join(reversed(sentence(random.Random(9)).split(" "))))], "doc_id long, text string")
    got = {x["doc_id"]: x["perplexity"] for x in classlm.score(odd, model).collect()}
    assert got[1] < got[2]


def test_choice_is_that_of_the_likelihood():
    """The class taken is the one that makes the class bigrams likeliest, by moving the word there and counting."""
    r = np.random.default_rng(5)
    for _ in range(50):
        bigrams = r.integers(50, 500, (6, 6))
        vector = r.integers(0, 20, (2, 6)) * (r.random((2, 6)) < 0.6)
        own = 2 + int(r.integers(0, 4))
        vector[:, 2:] = 0  # no neighbours in the classes it moves between, so the counts are exact
        def moved(to):
            out = bigrams.astype(float).copy()
            out[own, :] -= vector[0]
            out[:, own] -= vector[1]
            out[to, :] += vector[0]
            out[:, to] += vector[1]
            return likelihood(out)
        best = max(range(2, 6), key=lambda c: (round(moved(c), 6), c == own))
        assert classlm.best_classes(vector[None], np.array([own]), bigrams)[0] == best


def test_parts_and_flushes_change_nothing(spark, corpus, monkeypatch):
    _, frame = corpus
    want = classlm.fit(frame, classes=6, sweeps=3)
    monkeypatch.setattr(classlm, "GATHERED", 500)
    monkeypatch.setattr(classlm, "COUNT", 3)
    monkeypatch.setattr(classlm, "PART", 16)
    got = classlm.fit(frame.repartition(7), classes=6, sweeps=3)
    assert (got.classes == want.classes).all() and (got.bigrams == want.bigrams).all() and got.words.tokens == want.words.tokens


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(None, "some words"), (None, None)], "doc_id long, text string")
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in classlm.scored(frame).collect()] == [(True, 0, 0, 0.0, 0.0)] * 2
    assert classlm.scored(frame.limit(0)).collect() == []
    once = spark.createDataFrame([(k, f"u{k}") for k in range(20)], "doc_id long, text string")
    assert all(r["score"] < 0 for r in classlm.scored(once).collect())
