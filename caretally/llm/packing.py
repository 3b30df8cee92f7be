"""Best-two-fit packing of tokenised documents into sequences.

A document's ids (end id included) are one piece if they fit a sequence, else pieces of the full length, of which the first may be
shorter. Pieces of equal length are alike to the packing, so it is planned on the counts per length, at most as many numbers
as a sequence has tokens, whatever the corpus: a bin is filled greedily, the longest piece that fits first; then its
shortest piece is replaced by two unpacked ones if they fill the widened gap more tightly. A bin's pattern is repeated as long
as the counts allow the same choices. The plan names, for each pattern, the ranks of the pieces of each length that go there; pieces
are ranked by counts per (length, hash bucket) and a numbering within buckets, and look their places up in the plan. A length
has as many buckets as its own pieces need, and equal rows are dealt by their place, so no bucket grows with the corpus.

Rows: a null or empty text is a document of the end id alone. Rows with equal doc_id are separate documents with pieces of equal
numbers. A null doc_id is passed through. A long text gives as many pieces as it takes. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretally.llm.blocks import mix
from caretally.llm.store import table
from caretally.llm.tokens import encoded, tokenizer_path

LENGTH = 1024
#: Pieces of one length are numbered within hash buckets of about so many.
BUCKET_PIECES = 20_000


def pieces_of(documents: DataFrame, path: str, length: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids of every piece, and a number to deal it by, written to the
    shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, ids, cuts in encoded(batches, path):
            sizes = np.diff(cuts)
            number = -(-sizes // length)
            row = np.repeat(np.arange(j - i), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            first = sizes - (number - 1) * length
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            raw = ids.astype("<u4").tobytes()
            at = (cuts[row] + start) * 4
            cells = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
            crc = np.array([zlib.crc32(c) for c in cells], np.int64)
            deal = mix(mix(crc.astype(np.uint64)) + (row + i).astype(np.uint64)) >> np.uint64(1)
            columns = [batch.column(0).take(pa.array(row + i)), pa.array(piece), pa.array(start), pa.array(size), pa.array(crc), pa.array(deal.view(np.int64))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            if with_ids:
                columns.append(pa.array(cells, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, deal long" + ", ids binary" * with_ids
    return table(documents.select("doc_id", "text").mapInArrow(work, schema))


def filled(counts: np.ndarray) -> list[int]:
    """The lengths that go into the next bin; `counts` by length, not changed."""
    left, room, bin_ = counts.copy(), len(counts) - 1, []
    while room and len(fits := np.flatnonzero(left[:room + 1])):
        size = int(fits[-1])
        n = min(int(left[size]), room // size)
        bin_ += [size] * n
        left[size] -= n
        room -= size * n
    if room and len(bin_) > 1:
        small = bin_[-1]
        wide = room + small
        stock = np.flatnonzero(left)
        stock = stock[stock < wide]
        best = (small, 0, 0)
        for a in stock[::-1].tolist():
            if 2 * a < best[0]:
                break
            others = stock[(stock <= min(a, wide - a))]
            if len(others) and others[-1] == a and left[a] < 2:
                others = others[:-1]
            if len(others) and a + int(others[-1]) > best[0]:
                best = (a + int(others[-1]), a, int(others[-1]))
        if best[1]:
            bin_[-1:] = best[1:]
    return sorted(bin_, reverse=True)


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, end of ranks, first sequence, pieces of this length in a sequence, offset of the first)."""
    left, given, sequence, rows = counts.copy(), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        uses = Counter(filled(left))
        times = min(int(left[size]) // n for size, n in uses.items())
        offset = 0
        for size, n in uses.items():
            rows.append((size, given[size], given[size] + times * n, sequence, n, offset))
            given[size] += times * n
            left[size] -= times * n
            offset += size * n
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 6)


def packed(documents: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    pieces = pieces_of(documents, path or tokenizer_path(), length, with_ids)
    counts = np.zeros(length + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row per length
        counts[r["length"]] = r["n"]
    shared = documents.sparkSession.sparkContext.broadcast(plan(counts))
    buckets = F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-counts // BUCKET_PIECES))])
    dealt = pieces.withColumn("bucket", F.col("deal") % F.get(buckets, F.col("length").cast("int")))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("deal", "doc_id", "piece"))
    ranked = dealt.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    kept = [f for f in pieces.schema if f.name != "deal"]
    names = [*(f.name for f in kept), "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value[np.lexsort((shared.value[:, 1], shared.value[:, 0]))]
        keys = rows[:, 0] * (1 << 50) + rows[:, 1]
        for batch in batches:
            size, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            own = rows[np.searchsorted(keys, size * (1 << 50) + rank, "right") - 1]
            turn = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own[:, 3] + turn // own[:, 4]), pa.array(own[:, 5] + turn % own[:, 4] * size)], [*names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.select(*names).mapInArrow(place, schema)
