"""Suffix-array removal of repeated passages: every byte that a string of `LENGTH` bytes covers which also starts earlier.

All suffixes of a corpus are too many to sort at scale, so the array is sparse. In each window of LENGTH bytes the
`GRAM`-byte string with the least hash (the leftmost on a tie) is its anchor; equal windows have equal anchors at equal places. A
suffix is kept at each anchor, about one per 35 bytes, and stands for the run of windows that chose it.

1. Suffixes are range-partitioned by their leading bytes (then a hash of the gram, a hash of all bytes of the run, and the place) with
   sampled splitters, which may fall inside a hot key. Each bucket sorts itself by multikey quicksort. Neighbours with equal runs:
   the first stays, the windows of the others are removed. Runs that share a gram but differ have to be compared
   window by window; so do the runs at a bucket's borders, whose neighbours stand in another bucket.
2. Those runs fetch their bytes and send their windows in segments of `SEGMENT`, range-partitioned by a hash of the bytes that a segment's windows share,
   so that a hot gram in ever new surroundings is spread. Each bucket sorts its windows by multikey quicksort; all but the
   first of equal windows are removed.
3. First windows of the segments at a bucket's borders are compared across buckets: the least place of each is sought over all.

Equality is that of two independent hashes: 64 bits of a run's bytes and 32 of its gram, beside four leading bytes; 64 bits of a window's
bytes and 64 of those that its segment shares. Results do not depend on partitions.

Rows: null and empty texts, and those under LENGTH bytes, lose nothing. Rows with equal doc_id and text count as one document and get
the same result; other rows with equal doc_id are ordered by a hash of their text; null counts as the smallest doc_id. Long
texts are read in overlapping pieces. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretally.llm.blocks import BLOCK, Spans, list_array, row_of, string_buffers, text_blocks
from caretally.llm.store import table

LENGTH = 100
#: Bytes of the strings that are compared to choose anchors; a window has LENGTH - GRAM + 1 of them.
GRAM = 32
#: Rows a bucket sorts in memory, about: suffixes, and segments of windows.
BUCKET_ROWS, BUCKET_SEGMENTS = 1_000_000, 250_000
#: Neighbouring windows that are sent to be compared together.
SEGMENT = 6
NO_ID = -(1 << 63)
TOP = np.uint64(1 << 63)
SMALL = 1 << 15


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order that sorts rows by words[0], then words[1] and so on: three-way partition about a pivot of one word, the equal
    part going on with the next word. Small parts are sorted by the word at once, and their ties together by the words that follow."""
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(words):
            continue
        part = order[lo:hi]
        value = words[depth][part]
        if hi - lo <= SMALL:
            by = np.argsort(value, kind="stable")
            order[lo:hi], value = part[by], value[by]
            new = np.concatenate([[True], value[1:] != value[:-1], [True]])
            tied = np.flatnonzero(~(new[:-1] & new[1:]))
            if len(tied) and depth + 1 < len(words):
                own = order[lo + tied]
                order[lo + tied] = own[np.lexsort((*(w[own] for w in reversed(words[depth + 1:])), np.cumsum(new[:-1])[tied]))]
            continue
        pivot = np.sort(value[:: max(1, len(value) // 9)])[4]
        less, more = value < pivot, value > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def overlapping(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes of its text before these, bytes, offsets): blocks of texts; a long text in pieces that share
    LENGTH - 1 bytes, so that each window is in one."""
    for i, _, data, offsets in text_blocks(batch, "text"):
        if len(data) <= 2 * BLOCK:
            yield i, 0, data, offsets
            continue
        for a in range(0, len(data) - LENGTH + 1, BLOCK):
            piece = data[a:a + BLOCK + LENGTH - 1]
            yield i, a, piece, np.array([0, len(piece)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first window, shape, key and run hash of each anchor. Windows are counted by their starts in `data`; a shape is the
    number of further windows, and 256 times the way from the first window to the anchor."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    spans = Spans(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = Spans(data, which=1)(place, place + GRAM)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    width, covered = LENGTH - GRAM + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:len(least) - step], least[step:])
        covered += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    starts = np.arange(n)
    row = row_of(offsets, starts)
    good = starts + LENGTH <= offsets[row + 1]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1])
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:] - 1
    own = good[lo]
    lo, hi = lo[own], hi[own]
    at = anchor[lo]
    lead = data[at].astype(np.uint64) << np.uint64(24) | data[at + 1].astype(np.uint64) << np.uint64(16) | data[at + 2].astype(np.uint64) << np.uint64(8) | data[at + 3].astype(np.uint64)
    packed = (hi - lo) | (at - lo) << 8
    key = (lead << np.uint64(32) | gram[at] >> np.uint64(32)) ^ TOP
    run = spans(lo, hi + LENGTH) ^ (at - lo).astype(np.uint64)
    return row[lo], lo, packed, key.view(np.int64), run.view(np.int64)


def identified(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, tie, text and `row`, the other columns; `tie` tells rows of equal doc_id apart and is 0 where there are none. And id, tie
    and text of each document: rows that are equal in them are one."""
    ids = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).count()
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long")
    rows = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), tie.alias("tie"), "text", F.struct(*[c for c in documents.columns if c != "text"]).alias("row"))
    return rows, one_of_each(rows) if repeated else rows


def one_of_each(rows: DataFrame) -> DataFrame:
    """id, tie and text, once for each (id, tie). Only rows that have a copy are grouped, copies within a task first."""
    copied = table(rows.groupBy("id", "tie").count().where("count > 1").select("id", "tie"))
    own = rows.select("id", "tie", "text")
    if not copied.limit(1).count():
        return own
    one = own.join(copied, ["id", "tie"], "left_semi").groupBy("id", "tie").agg(F.first("text").alias("text"))
    return own.join(copied, ["id", "tie"], "left_anti").unionByName(one)


def suffixes(rows: DataFrame) -> DataFrame:
    """key, run, id, tie, lo (its first window) and shape of every anchor."""
    names = ["key", "run", "id", "tie", "lo", "shape"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, before, data, offsets in overlapping(batch):
                row, lo, shape, key, run = anchors(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(run), pa.array(ids[row + i]), pa.array(ties[row + i]), pa.array((lo - offsets[row] + before).astype(np.int32)), pa.array(shape.astype(np.int32))], names)

    return rows.select("id", "tie", "text").mapInArrow(work, "key long, run long, id long, tie long, lo int, shape int")


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def new_groups(*words: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before in any of the words."""
    out = np.ones(len(words[0]), bool)
    out[1:] = False
    for w in words:
        out[1:] |= w[1:] != w[:-1]
    return out


def sorted_runs(records: DataFrame, buckets: int) -> DataFrame:
    """id, tie, lo, shape and `open`: runs that stand earlier too (open false), and runs to be compared window by window (true)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        if held is None:
            return
        key, run, id_, tie, lo, shape = (held[c].to_numpy() for c in held.column_names)
        order = multikey_order([key, run, id_, tie, lo])
        key, run, id_, tie, lo, shape = (x[order] for x in (key, run, id_, tie, lo, shape))
        first = new_groups(key, run)
        begins = new_groups(key)
        group = np.cumsum(begins) - 1
        classes = np.bincount(group, weights=first)
        classes[[0, -1]] = 2  # the neighbouring buckets may hold more of these keys
        again, open_ = np.flatnonzero(~first), np.flatnonzero(first & (classes[group] > 1))
        take = np.concatenate([again, open_])
        yield pa.RecordBatch.from_arrays([*(pa.array(x[take]) for x in (id_, tie, lo, shape)), pa.array(np.arange(len(take)) >= len(again))], ["id", "tie", "lo", "shape", "open"])

    dealt = records.repartitionByRange(buckets, "key", "run", "id", "tie", "lo")
    return dealt.mapInArrow(work, "id long, tie long, lo int, shape int, open boolean")


def segments(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """core, id, tie, lo and window hashes of up to SEGMENT neighbouring windows of a run, cut at fixed distances from its anchor; core
    is a hash of the bytes that all windows of such a segment share."""
    asked = runs.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "shape")).alias("asked"))  # at most a text's anchors
    names = ["core", "id", "tie", "lo", "windows"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            lists, flat = batch.column(3), batch.column(3).flatten()
            own = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            all_lo, shape = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
            for a in range(0, len(own), 20_000):
                row, lo, n, back = own[a:a + 20_000], all_lo[a:a + 20_000], shape[a:a + 20_000] & 255, shape[a:a + 20_000] >> 8
                size = n + LENGTH
                begin = np.cumsum(size) - size
                own_bytes = data[np.repeat(offsets[row] + lo - begin, size) + np.arange(size.sum())]
                spans, shared = Spans(own_bytes), Spans(own_bytes, which=1)
                rec = np.repeat(np.arange(len(row)), n + 1)
                step = np.arange(len(rec)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
                window = spans(begin[rec] + step, begin[rec] + step + LENGTH).view(np.int64)
                part = (back[rec] - step) // SEGMENT
                first = np.flatnonzero(new_groups(rec, part))
                start = begin[rec[first]] + back[rec[first]] - SEGMENT * part[first]
                core = shared(start, start + LENGTH - SEGMENT + 1).view(np.int64)
                who = pa.array(row[rec[first]])
                yield pa.RecordBatch.from_arrays([pa.array(core), batch.column(0).take(who), batch.column(1).take(who), pa.array((lo[rec[first]] + step[first]).astype(np.int32)), list_array(window, np.append(first, len(window)))], names)

    return rows.select("id", "tie", "text").join(asked, ["id", "tie"]).select("id", "tie", "text", "asked").mapInArrow(work, "core long, id long, tie long, lo int, windows array<long>")


def sorted_windows(parts: DataFrame, buckets: int) -> DataFrame:
    """id, tie, lo, n, window and core: windows from lo on, n more, that stand earlier too (window null), and the first windows of the
    cores at a bucket's borders, by their hashes."""
    names = ["id", "tie", "lo", "n", "window", "core"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        if held is None:
            return
        core, id_, tie, lo = (held[c].to_numpy() for c in names_in[:4])
        lists = held["windows"].chunk(0) if isinstance(held["windows"], pa.ChunkedArray) else held["windows"]
        number = np.diff(np.asarray(lists.offsets))
        rec = np.repeat(np.arange(len(core)), number)
        step = np.arange(len(rec)) - np.repeat(np.cumsum(number) - number, number)
        window = np.asarray(lists.flatten())
        ids, ties, place = id_[rec], tie[rec], lo[rec] + step
        order = multikey_order([window, core[rec], ids, ties, place])
        first = np.empty(len(order), bool)
        first[order] = new_groups(window[order], core[rec][order])
        gone = np.flatnonzero(~first)
        heads = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (rec[gone[1:]] != rec[gone[:-1]])])) if len(gone) else gone
        n, head = np.diff(np.append(heads, len(gone))) - 1, gone[heads]
        border = (core == core.min()) | (core == core.max())  # buckets are ranges of cores
        edge = np.flatnonzero(first & border[rec])
        for take, more, hashes in ((head, n, pa.nulls(len(head), pa.int64())), (edge, np.zeros(len(edge)), pa.array(window[edge]))):
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(ties[take]), pa.array(place[take].astype(np.int32)), pa.array(more.astype(np.int32)), hashes, pa.array(core[rec[take]])], names)

    names_in = ["core", "id", "tie", "lo", "windows"]
    return parts.repartitionByRange(buckets, *names_in[:4]).mapInArrow(work, "id long, tie long, lo int, n int, window long, core long")


def repeated(rows: DataFrame) -> DataFrame:
    """id, tie, lo, n: runs of n + 1 windows from lo on that also start earlier. Of rows with equal (id, tie) there has to be one."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = table(sorted_runs(suffixes(rows), max(least, int(size / 35 / BUCKET_ROWS) + 1)))
    parts = table(segments(runs.where("open").select("id", "tie", "lo", "shape"), rows))
    windows = table(sorted_windows(parts, max(least, int(parts.count() / BUCKET_SEGMENTS) + 1)))
    edge = windows.where("window IS NOT NULL")
    earliest = edge.groupBy("window", "core").agg(F.min(F.struct("id", "tie", "lo")).alias("e"), F.count("*").alias("c")).where("c > 1")
    across = edge.join(earliest, ["window", "core"]).where(F.struct("id", "tie", "lo") != F.col("e"))
    columns = ["id", "tie", "lo", "n"]
    return runs.where("NOT open").select("id", "tie", "lo", F.col("shape").bitwiseAND(F.lit(255)).alias("n")).unionByName(windows.where("window IS NULL").select(*columns)).unionByName(across.select(*columns))


def reduced(documents: DataFrame, with_text: bool) -> DataFrame:
    """row (the columns but text), n_bytes, n_removed, n_spans, kept_sha256 of every row and, if wanted, kept_text."""
    rows, distinct = identified(documents)
    spans = repeated(distinct).groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))  # at most a text's windows
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            out = []
            for k, found in enumerate(batch.column(2)):
                text = data[offsets[k]:offsets[k + 1]]
                kept, count = text, 0
                if found.is_valid and len(found):
                    flat = found.values
                    lo, n = (flat.field(c).to_numpy() for c in range(2))
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept, count = text[~gone], int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                raw = kept.tobytes()
                out.append((len(text), len(text) - len(kept), count, hashlib.sha256(raw).hexdigest(), raw.decode(errors="ignore") if with_text else None))
            columns = [pa.array([x[c] for x in out], pa.int64() if c < 3 else pa.string()) for c in range(4 + with_text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    joined = rows.join(spans, ["id", "tie"], "left").select("row", "text", "spans")
    kinds = [T.StructField(c, T.LongType()) for c in names[1:4]] + [T.StructField(c, T.StringType()) for c in names[4:]]
    return joined.mapInArrow(work, T.StructType([T.StructField("row", joined.schema["row"].dataType), *kinds]))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return reduced(documents.select("doc_id", "text"), False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cleaned(documents: DataFrame) -> DataFrame:
    """The documents with what is kept of their texts (a character that was cut through goes altogether; null becomes empty)
    and, if there is such a column, n_chars to match."""
    out = reduced(documents, True)
    chars = F.length("kept_text")
    return out.select(*[F.col("kept_text").alias(c) if c == "text" else chars.cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
