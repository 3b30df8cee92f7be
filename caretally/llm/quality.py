"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

Word unigrams and bigrams (A-Z folded) are hashed to buckets, one per `LOAD` bytes of text, so that their load does not grow with the
corpus (`BUCKETS` at least, `MOST_BUCKETS` at most, as each task sends a table of that size). Two multinomials over the buckets are
counted: over all documents (raw) and over all trusted ones (labelled quality 1). A document's score is the sum over its
n-grams of log(target share / raw share), divided by their number plus `SMOOTH`; it is kept if the score reaches `MIN_SCORE`. No draw is
made: equal texts get equal verdicts.

Trusted rows are found without moving a text. A Bloom filter of the trusted ids (in blocks of `FILTER_IDS`, by hash) is broadcast; a pass
counts the rows that go through and returns their ids. Ids that went through wrongly (about one in a million) are found by a join
of ids, and their counts are taken off again by the same way, until none is left. The plan is the same at every size.

Base rules: fewer than 10 words, or more than a fifth of the words in repeated five-word windows.

Rows: a null or empty text has no words, fails the base rules and scores 0. Repeated rows are judged alike, each by itself.
Any doc_id, null included, is passed through; only doc_id and text are read, whatever other columns there are. Without
labels the target is empty, every ratio is that of the smoothing, and the score is near 0. Texts are read whole; a task holds
one block of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.llm.blocks import gram_hashes, mix, row_of, span_hashes, text_blocks, word_hashes, word_spans
from caretally.llm.store import table

#: Bytes of text per hash bucket of the n-grams, and the least and the greatest number of buckets.
LOAD, BUCKETS, MOST_BUCKETS = 4_000, 10_000, 1 << 18
#: Buckets whose counts go together.
STRETCH = 1 << 14
#: Ids per Bloom filter, its bits per id, and its hashes.
FILTER_IDS, FILTER_BITS, FILTER_HASHES = 4_000_000, 32, 16
#: Mean log ratio per n-gram below which a document is dropped.
MIN_SCORE = -0.06
#: So many n-grams of no evidence are added to each text, lest a few odd words condemn a short one.
SMOOTH = 40
MIN_WORDS, MAX_REPEATED = 10, 20
SYMBOLS = b"#*$%&|<>"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def equal_to_another(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys have an equal one before them (in any fixed order), and which have an equal one at all."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def keyed(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return values + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text, as in COUNTS."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    rows = row_of(offsets, starts)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    blank = np.zeros(256, bool)
    blank[[0x20, *range(9, 14)]] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    char = ~blank & ((np.arange(256) & 0xC0) != 0x80)

    breaks = np.flatnonzero(data == 10)
    firsts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    firsts = firsts[firsts < len(data)]
    ends_of_text = offsets[1:][row_of(offsets, firsts)] if len(firsts) else firsts
    lasts = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, firsts)], ends_of_text)
    worded = np.searchsorted(starts, lasts) > np.searchsorted(starts, firsts)
    firsts, lasts = firsts[worded], lasts[worded]
    line_rows = row_of(offsets, firsts)
    again, _ = equal_to_another(keyed(span_hashes(data, firsts, lasts, False), line_rows))

    grams, first = gram_hashes(span_hashes(data, starts, ends, False), rows, 5)
    _, twice = equal_to_another(keyed(grams, rows[first]))
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {"n_words": np.bincount(rows, minlength=n), "word_chars": per_row(char[data]), "n_symbols": per_row(symbol[data]),
            "n_dup_lines": np.bincount(line_rows[again], minlength=n), "n_repeat_words": np.bincount(rows[covered], minlength=n)}


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and each pair of neighbouring words."""
    words, rows, _, _ = word_hashes(data, offsets)
    pairs, first = gram_hashes(words, rows, 2)
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[first]])


def bucket_number(documents: DataFrame) -> int:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, size // LOAD))


def filter_places(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each id in a Bloom filter, one per hash."""
    a = mix(ids.astype(np.int64).view(np.uint64))
    step = mix(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for _ in range(FILTER_HASHES):
        yield (a % np.uint64(bits)).astype(np.int64)
        a = a + step


def bloom_filter(ids: DataFrame, n: int) -> np.ndarray:
    """The bits of a filter of n ids, set by the tasks and united."""
    size = max(1024, -(-n * FILTER_BITS // 8))
    part = 1 << 16

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(size * 8, bool)
        for batch in batches:
            for places in filter_places(batch.column(0).to_numpy(), size * 8):
                flags[places] = True
        bits = np.packbits(flags, bitorder="little")
        starts = [k for k in range(0, size, part) if bits[k:k + part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([bits[k:k + part].tobytes() for k in starts], pa.binary())], ["start", "bits"])

    bits = np.zeros(size, np.uint8)
    for row in ids.coalesce(8).mapInArrow(work, "start long, bits binary").toLocalIterator():  # at most 8 filters of FILTER_IDS ids
        own = np.frombuffer(row["bits"], np.uint8)
        bits[row["start"]:row["start"] + len(own)] |= own
    return bits


def passing(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for places in filter_places(ids, 8 * len(bits)):
        out &= (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
    return out


def counted(documents: DataFrame, buckets: int, filters: list[np.ndarray] | None) -> DataFrame:
    """(start, counts): n-grams of the rows whose doc_id goes through all filters (of all rows without filters), as 64-bit counts of the
    STRETCH buckets from start on, one row per task and stretch; and, with a null start, the doc_ids that went through.
    Written to the shared folder."""
    shared, stretch = documents.sparkSession.sparkContext.broadcast(filters), STRETCH

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if shared.value is not None:
                own = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                for bits in shared.value:
                    own[own] = passing(bits, ids[own])
                batch = batch.filter(pa.array(own))
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), ids], ["start", "counts", "doc_id"])
            for _, _, data, offsets in text_blocks(batch, "text"):
                total += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        starts = [k for k in range(0, buckets, stretch) if total[k:k + stretch].any()]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([total[k:k + stretch].tobytes() for k in starts], pa.binary()), pa.nulls(len(starts), pa.int64())], ["start", "counts", "doc_id"])

    return table(documents.select("doc_id", "text").mapInArrow(work, "start long, counts binary, doc_id long"))


def gathered(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all tasks, added up stretch by stretch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[start] = sums.get(start, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["start", "counts"])

    out = np.zeros(buckets, np.int64)
    for row in counts.where("start IS NOT NULL").select("start", "counts").repartition("start").mapInArrow(work, "start long, counts binary").collect():  # one row per stretch
        own = np.frombuffer(row["counts"], np.int64)
        out[row["start"]:row["start"] + len(own)] = own
    return out


def counts_of_ids(documents: DataFrame, ids: DataFrame, buckets: int) -> np.ndarray:
    """Bucket counts over the documents with one of the ids, each of which is in the table once."""
    total, sign, filters = np.zeros(buckets, np.int64), 1, []
    while n := ids.count():
        filters.append(bloom_filter(ids, n))
        found = counted(documents, buckets, filters)
        total += sign * gathered(found, buckets)
        ids = table(found.where("doc_id IS NOT NULL").select("doc_id").distinct().join(ids, "doc_id", "left_anti"))
        sign = -sign
    return total


def bucket_counts(documents: DataFrame, labels: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams' buckets over all documents, and over the trusted ones."""
    trusted = table(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    blocks = -(-trusted.count() // FILTER_IDS)
    target = np.zeros(buckets, np.int64)
    for b in range(blocks):
        target += counts_of_ids(documents, trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b), buckets)
    return gathered(counted(documents, buckets, None), buckets), target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target share / raw share) per bucket, each bucket counted once more than seen."""
    raw, target = raw + 1.0, target + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge(documents: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every document."""
    buckets = bucket_number(documents)
    shared = documents.sparkSession.sparkContext.broadcast(log_ratios(*bucket_counts(documents, labels, buckets)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                counts = base_counts(data, offsets)
                bucket, rows = features(data, offsets, buckets)
                number = np.bincount(rows, minlength=j - i)
                score = np.bincount(rows, weights=ratios[bucket], minlength=j - i) / (number + SMOOTH)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(failed), pa.array(~failed & (score >= min_score)), pa.array(score)],
                    ["doc_id", *counts, "base_failed", "kept", "score"])

    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id long, {COUNTS}, base_failed boolean, kept boolean, score double")
