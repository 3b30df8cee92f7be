"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from caretally.llm import runs

from .test_operators import SCHEMA, prose, texts, words


def plain_lyndon(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and not word[j:] < word[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(word, least):
    """(start, length, period), by every period and place."""
    n, out = len(word), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and word[i] == word[i + q]:
                i += 1
            size = i + q - s
            smaller = any(word[s:s + size - d] == word[s + d:s + size] for d in range(1, q))
            if i > s and size >= max(least, 2 * q) and not smaller:
                out.add((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, least=12):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, least)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept)


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_lyndon_arrays_and_runs(letters):
    r = random.Random(letters)
    for _ in range(400):
        word = [r.randrange(letters) for _ in range(r.randrange(1, 45))]
        assert runs.lyndon_lengths(word) == plain_lyndon(word)
        for least in (2, 12):
            begin, length, period = runs.all_runs(np.array(word), np.zeros(len(word), np.int64), least)
            assert list(zip(begin.tolist(), length.tolist(), period.tolist(), strict=True)) == plain_runs(word, least)


def test_rows_do_not_mix():
    line = np.array([1, 2] * 8 + [1, 2] * 8 + [3] * 5 + [3] * 13)
    begin, length, period = runs.all_runs(line, np.repeat([0, 1, 2, 3], [16, 16, 5, 13]))
    assert (begin.tolist(), length.tolist(), period.tolist()) == ([0, 16, 37], [16, 16, 13], [2, 2, 1])


def test_documents(spark):
    r = random.Random(2)
    some = [t for t in texts() if len(words(t)) < 2_000]
    some += ["na " * 40, "x y " * 6, "x y " * 5 + "x", " ".join(r.choice("ab") for _ in range(200)), prose(1, 30) + " " + prose(1, 30), "é è " * 14, "tail " + prose(3, 9) + "\n" + prose(3, 9) + " ends"]
    rows = [(k, t, "en", "s", 0, 7, "v", 0.5, 1) for k, t in enumerate(some * 4)] + [(None, "a b c " * 8, None, None, None, None, None, None, None), (5, "again " * 12, "en", "s", 0, 7, "v", 0.5, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in runs.collapsed(frame, plant=True, with_text=True).collect()), key=lambda x: (x[0] is not None, x[0], x[6]))
    want = sorted(((x[0], *plain(x[0], x[1])) for x in rows), key=lambda x: (x[0] is not None, x[0], x[6]))
    assert got == want and sum(x[1] > 0 for x in want) > 30 and any(x[0] is not None and zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in want)
    assert runs.collapsed(frame.limit(0)).collect() == []


def test_long_text(spark):
    unit = prose(8, 700)
    text = prose(9, 5_000) + " " + f"{unit} " * 40 + prose(10, 5_000)
    got = runs.collapsed(spark.createDataFrame([(1, text), (2, "z " * 300_000)], "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_runs"], x["length"] // x["period"], x["period"]) for x in got} == {1: (1, 40, 700), 2: (1, 300_000, 1)}
