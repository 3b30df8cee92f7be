"""Periodic runs of a text's words, by Baier's grouping, and the text with all but their first periods taken out.

A run is a stretch of consecutive words with smallest period q and at least two periods that no neighbouring word extends. Each run has a
Lyndon word of length q, its root, that is the longest one starting at its place under the order of the words or under the
reversed order.

1. Words are numbered per block by an exact dictionary. A word that stands only once in a stretch lies in none of its runs, so stretches
   are cut at such words until none is left, and those below the least length are dropped. Nothing is lost by that.
2. The first phase of Baier's suffix sorter, run on a stretch under both orders, gives the Lyndon arrays as the context lengths
   of its final groups.
3. Each root is extended to both sides as far as the words a period apart are equal: longest common extensions are looked up in
   names of all substrings of 1, 2, 4, ... words, which are exact. Extensions of at least two periods are runs.

Work stays within a document, so nothing is shuffled; a task holds one block of texts, or one long text, at a time.

Rows: a null, empty or blank text has no words, no runs, four nulls and the hashes of the empty string. A null doc_id is
passed through (`planted` leaves its text as it is). Repeated rows are treated alike. Only doc_id and text are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from caretally.llm.blocks import row_of, text_blocks, word_spans

#: Least words of a run.
LEAST = 12
FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal bytes only."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    packed = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    return pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def planted(doc_ids: list, rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each word of a block the word that stands in its place: in one document of ten the words from some place on repeat the
    first of them over and over, place and period by a checksum of doc_id."""
    source = np.arange(len(rows))
    for k, doc_id in enumerate(doc_ids):
        n = int(firsts[k + 1] - firsts[k])
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[firsts[k] + a:firsts[k + 1]] = firsts[k] + a + np.arange(n - a) % p
    return source


def recurring(codes: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words that lie in stretches of at least `least` words each of which stands in it twice or more, and the number
    of each one's stretch."""
    place, stretch = np.arange(len(codes)), rows
    while len(place):
        key = stretch * (int(codes.max()) + 1) + codes[place]
        _, back, number = np.unique(key, return_inverse=True, return_counts=True)
        good = number[back] > 1
        kept = place[good]
        cut = np.ones(len(kept), bool)
        cut[1:] = (kept[1:] != kept[:-1] + 1) | (stretch[good][1:] != stretch[good][:-1])
        parts = np.cumsum(cut) - 1
        long = np.bincount(parts, minlength=1)[parts] >= least if len(parts) else np.zeros(0, bool)
        done = bool(good.all())
        place, stretch = kept[long], parts[long]
        if done and long.all():
            break
    return place, stretch


def lyndon_lengths(word: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place.

    Suffixes are kept in groups, ordered by the context that their members begin with, at first one word. From the highest group
    down, each member's nearest place to the left that is in a lower group takes the member's context behind its own, once per such member: it
    moves up into a new group next above its old one. The group a suffix ends in has its longest Lyndon prefix as context.
    """
    n = len(word)
    order = sorted(range(n), key=word.__getitem__)
    at, group = [0] * n, [0] * n  # place in the order; group, named by the first place it ever had
    size, length = [0] * n, [1] * n  # by group
    last = -1
    for k, s in enumerate(order):
        at[s] = k
        if last < 0 or word[order[last]] != word[s]:
            last = k
        group[s] = last
        size[last] += 1
    before = [-1] * n
    end = n
    while end > 0:
        top = group[order[end - 1]]
        extent = length[top]
        if end - top == 1:
            s = order[top]
            j = s - 1
            while j >= 0 and group[j] > top:
                j = before[j]
            before[s] = j
            if j >= 0:
                old = group[j]
                if size[old] == 1:
                    length[old] += extent
                else:
                    size[old] -= 1
                    new, here = old + size[old], at[j]
                    other = order[new]
                    order[here], at[other], order[new], at[j] = other, here, j, new
                    group[j], size[new], length[new] = new, 1, length[old] + extent
            end = top
            continue
        times: dict[int, int] = {}
        for s in sorted(order[top:end]):
            j = s - 1
            while j >= 0 and group[j] >= top:
                j = before[j]
            before[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, r in times.items():
            levels.setdefault(r, []).append(j)
        for r in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for j in levels[r]:
                old = group[j]
                size[old] -= 1
                moved[old] = moved.get(old, 0) + 1
                new, here = old + size[old], at[j]
                other = order[new]
                order[here], at[other], order[new], at[j] = other, here, j, new
            renamed = {old: (old + size[old], count, length[old] + r * extent) for old, count in moved.items()}
            for j in levels[r]:
                group[j] = renamed[group[j]][0]
            for new, count, context in renamed.values():
                size[new], length[new] = count, context
        end = top
    return [length[g] for g in group]


def names_of_powers(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: a number for the 2 ** k codes from each place on, equal for equal codes only; until all differ."""
    names = [np.unique(codes, return_inverse=True)[1]]
    step = 1
    while 2 * step <= len(codes):
        last = names[-1]
        pair = last[:-step] * (len(codes) + 1) + last[step:]
        values, name = np.unique(pair, return_inverse=True)
        if len(values) == len(pair):
            break
        names.append(name)
        step *= 2
    return names


def common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, backwards: bool = False) -> np.ndarray:
    """How many codes from a and from b > a on are equal; with `backwards`, how many before them."""
    out = np.zeros(len(a), np.int64)
    for k in [*range(len(names) - 1, -1, -1)]:
        name, step = names[k], 1 << k
        open_ = np.arange(len(a))
        while len(open_):
            x, y = (a[open_] - out[open_] - step, b[open_] - out[open_] - step) if backwards else (a[open_] + out[open_], b[open_] + out[open_])
            inside = (x >= 0) & (y < len(name)) & (x < len(name))
            equal = np.zeros(len(open_), bool)
            equal[inside] = name[x[inside]] == name[y[inside]]
            open_ = open_[equal]
            out[open_] += step
            if k < len(names) - 1:
                break
    return out


def all_runs(codes: np.ndarray, rows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and period of every run of at least `least` words within a row, by start and then period."""
    place, stretch = recurring(codes, rows, max(2, least))
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    bounds = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    bounds = np.append(bounds, len(place))
    # A code of its own behind each stretch keeps extensions inside.
    inner = np.arange(len(place)) + stretch - stretch[0]
    line = np.full(inner[-1] + 2, -1, np.int64)
    line[inner] = codes[place]
    gaps = np.flatnonzero(line < 0)
    line[gaps] = codes.max() + 1 + np.arange(len(gaps))
    where = np.full(len(line), -1, np.int64)
    where[inner] = place
    names = names_of_powers(line)
    begins, periods = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        word = codes[place[a:b]]
        for letters in (word, -word):
            periods.append(np.array(lyndon_lengths(letters.tolist()), np.int64))
            begins.append(inner[a:b])
    begin, period = np.concatenate(begins), np.concatenate(periods)
    right = common(names, begin, begin + period)
    left = common(names, begin, begin + period, backwards=True)
    length = left + right + period
    good = (length >= 2 * period) & (length >= least)
    found = np.unique(np.stack([(begin - left)[good], period[good], length[good]], 1), axis=0)
    return where[found[:, 0]], found[:, 2], found[:, 1]


def collapsed(documents: DataFrame, plant: bool = False, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """doc_id, the number of runs, the longest one, checksums of all runs and of the words without repeats (and, if wanted, these words,
    one blank apart). With `plant`, some texts are made periodic first."""
    names = ["doc_id", *(f.split(" ")[0] for f in FOUND.split(", "))] + ["collapsed"] * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                starts, ends = word_spans(data, offsets)
                rows = row_of(offsets, starts)
                firsts = np.searchsorted(rows, np.arange(j - i + 1))
                ids = batch.column(0).slice(i, j - i)
                if plant:
                    source = planted(ids.to_pylist(), rows, firsts)
                    starts_now, ends_now = starts[source], ends[source]
                else:
                    source, starts_now, ends_now = np.arange(len(rows)), starts, ends
                codes = word_codes(data, starts, ends)[source] if len(starts) else np.zeros(0, np.int64)
                begin, length, period = all_runs(codes, rows, least)
                edge = np.zeros(len(rows) + 1, np.int64)
                np.add.at(edge, begin + period, 1)
                np.add.at(edge, begin + length, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
                size = ends_now[kept] - starts_now[kept] + 1
                stop = np.cumsum(size)
                take = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts_now[kept] - (stop - size), size)
                text = np.append(data, np.uint8(32))[np.minimum(take, len(data))]
                text[stop - 1] = 32
                cuts = np.concatenate([[0], stop])[np.searchsorted(rows[kept], np.arange(j - i + 1))]
                owner = np.searchsorted(rows[begin] if len(begin) else begin, np.arange(j - i + 1))
                out = []
                for k in range(j - i):
                    own = slice(owner[k], owner[k + 1])
                    s, n, p = begin[own] - firsts[k], length[own], period[own]
                    lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), p.tolist(), strict=True))
                    best = int(np.argmax(n)) if len(n) else -1  # the first of equals has the least start, then period
                    longest = (int(s[best]), int(n[best]), int(p[best]), 1000 * int(n[best]) // int(p[best])) if len(n) else (None,) * 4
                    words = text[cuts[k]:max(cuts[k], cuts[k + 1] - 1)].tobytes()
                    out.append((len(n), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(words).hexdigest(), *([words.decode()] * with_text)))
                columns = [pa.array([x[c] for x in out], pa.int64() if c < 5 else pa.string()) for c in range(7 + with_text)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id long, {FOUND}" + ", collapsed string" * with_text)
