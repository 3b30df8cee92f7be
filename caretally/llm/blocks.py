"""Vectorised reading of text columns inside Arrow tasks: words, word shingles and byte hashes.

Texts are seen as UTF-8 bytes. Arrays are made for at most `BLOCK` bytes at a time (one longer text alone), so a task's
memory does not depend on how many rows it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
SHINGLE = 5
#: Two multipliers of polynomial hashes; the second is for a check of the first.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MULTIPLIER = MULTIPLIERS[0]
INVERSES = tuple(pow(m, -1, 1 << 64) for m in MULTIPLIERS)
#: Longer spans are hashed by xxh3: polynomials modulo 2 ** 64 are weak on long regular strings.
LONG = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(fold: bool) -> np.ndarray:
    """A random-looking 64-bit value per byte; with `fold`, A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
    if fold:
        table[65:91] = table[97:123]
    return table


def space_table() -> np.ndarray:
    """True for the bytes that separate words: blank and 9 to 13."""
    table = np.zeros(256, bool)
    table[[0x20, *range(9, 14)]] = True
    return table


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null texts are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = array.buffers()[2] if len(array) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return data[first:last], offsets - first


def text_blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows that hold at most `size` bytes, or of one row."""
    data, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def row_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, places, "right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end at blanks and at the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space_table()[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | cut[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands. `which` chooses one of two independent hashes."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG)
    for k, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(LOWER[data[s:e]] if fold else data[s:e]), seed=which)
    short = np.flatnonzero(ends - starts <= LONG)
    first, last = starts[short], ends[short]
    size = min(BLOCK + LONG, int(last[-1] - first[0]) if len(short) else 0)
    up, down = powers(MULTIPLIERS[which], size), powers(INVERSES[which], size)
    table = byte_table(fold) if which == 0 else mix(byte_table(fold))
    i = 0
    while i < len(short):
        base = int(first[i])
        j = int(np.searchsorted(first, base + BLOCK, "right"))
        top = int(last[j - 1]) - base
        sums = np.zeros(top + 1, np.uint64)
        np.cumsum(table[data[base:base + top]] * up[:top], dtype=np.uint64, out=sums[1:])
        s, e = first[i:j] - base, last[i:j] - base
        out[short[i:j]] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def eight_bytes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[places]


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span's bytes, from its first and last eight bytes where these are all of it."""
    size = (ends - starts).astype(np.uint64)
    head = eight_bytes(data, starts) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(size, np.uint64(8)))))
    tail = np.where(size > 8, eight_bytes(data, np.maximum(ends - 8, 0)), np.uint64(0))
    key = mix(head + size * np.uint64(MULTIPLIERS[0])) + mix(tail ^ np.uint64(MULTIPLIERS[1]))
    check = mix(tail + size * np.uint64(MULTIPLIERS[1])) ^ mix(head ^ np.uint64(MULTIPLIERS[0]))
    for k in np.flatnonzero(size > 16).tolist():
        whole = xxhash.xxh3_128_intdigest(np.ascontiguousarray(data[starts[k]:ends[k]]))
        key[k], check[k] = whole >> 64, whole & 0xFFFFFFFFFFFFFFFF
    return mix(key), mix(check)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word; with `fold`, A-Z count as a-z."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends, fold), row_of(offsets, starts), starts, ends


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `n` words within a row, and the index of its first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:m] == rows[n - 1:])
    total = np.full(len(first), n, np.uint64)
    for k, factor in enumerate(mix(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)):
        total += words[first + k] * factor
    return mix(total), first


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each `n`-word shingle, in row order; a row of fewer words has its whole sequence as the one shingle."""
    values, first = gram_hashes(words, rows, n)
    owner = rows[first]
    if len(rows):
        which, at, counts = np.unique(rows, return_index=True, return_counts=True)
        parts, owners = [values], [owner]
        for m in range(1, n):
            few = counts == m
            if few.any():
                own = np.repeat(few, counts)
                v, f = gram_hashes(words[own], rows[own], m)
                parts.append(v)
                owners.append(rows[own][f])
        if len(parts) > 1:
            values, owner = np.concatenate(parts), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
    return values, owner


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, which is slower where most values are distinct."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def distinct_by_row(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row as signed numbers in ascending order, and offsets per row."""
    cuts = np.searchsorted(owner, np.arange(rows + 1))
    signed = values.view(np.int64)
    parts = [sorted_distinct(signed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.fromiter((len(x) for x in parts), np.int64, rows)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))


def pieces(batch: pa.RecordBatch, column: str, separator: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): as text_blocks, but a text beyond `size` comes in several pieces, cut behind separators."""
    for i, _, data, offsets in text_blocks(batch, column, size):
        if len(data) <= 2 * size:
            yield i, data, offsets
            continue
        a = 0
        while a < len(data):
            b = min(a + size, len(data))
            while b < len(data):  # goes on to the next separator
                found = np.flatnonzero(separator[data[b - 1:b - 1 + size]])
                if len(found):
                    b += int(found[0])
                    break
                b = min(b + size, len(data))
            yield i, data[a:b], np.array([0, b - a])
            a = b


class Spans:
    """Hashes of any short spans of a piece, by one of two independent polynomials."""

    def __init__(self, data: np.ndarray, fold: bool = False, which: int = 0):
        n = len(data)
        table = byte_table(fold) if which == 0 else mix(byte_table(fold))
        self.down = powers(INVERSES[which], n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(MULTIPLIERS[which], n)[:n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
