"""Token ids in canonical, length-limited Huffman code.

The corpus is tokenised once into an intermediate table; ids are counted over all of it; code lengths come from package-merge
with at most `MAX_BITS` bits. Documents are range-partitioned and sorted by doc_id, and each partition writes its files, so that
the files in order of their names hold the documents in ascending doc_id order.

A file: magic; one bit stream of all ids in blocks of `BLOCK_TOKENS`; then the sections lengths (one byte per id of the
vocabulary), checkpoints (bit offset of each block), doc_ids, whether they are null, and token counts; then a footer with the sizes. A canonical code needs no more
than the lengths. Every block can be decoded by itself from its checkpoint; the reader decodes many blocks side by side, a
table look-up per id.

Rows: a null or empty text has the end id alone. Null doc_ids come first; equal ones keep an arbitrary order among
themselves. A text of any length is kept whole, over several blocks. An empty table writes no file and gives no rows. Other
columns are not read. A broken file raises ValueError.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretally.llm.store import shared_folder, table
from caretally.llm.tokens import encoded, tokenizer_path

MAX_BITS = 20
BLOCK_TOKENS = 1024
#: A file is closed behind the document that fills it to so many ids.
FILE_TOKENS = 32 << 20
#: Ids that are coded, and blocks that are decoded, at a time.
PART_TOKENS, SIDE_BY_SIDE = 1 << 20, 2048
MAGIC = b"CANHUF1\n"
FOOTER = "<QQQIII8s"


def tokenised(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the ids, end id included, as little-endian 16-bit numbers (32-bit for large vocabularies)."""
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, ids, cuts in encoded(batches, path):
            raw, size = ids.astype(width).tobytes(), np.dtype(width).itemsize
            cells = [raw[a * size:b * size] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cuts)), pa.array(cells, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return table(documents.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids binary")), width


def token_counts(rows: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs: at most one entry per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                part = np.bincount(np.frombuffer(cell.as_buffer(), width))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[:len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each id's code (0 for ids that do not occur) by package-merge: the best code of at most `limit` bits."""
    ids = np.array(sorted(counts, key=lambda i: (counts[i], i)), np.int64)
    lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint8)
    n = len(ids)
    if n == 1:
        lengths[ids] = 1
    if n < 2:
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    weights = np.array([counts[i] for i in ids], np.int64)
    single, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        single.append(order < n)
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for alone in reversed(single):
        own = int(alone[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[ids] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id, each the next number."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, word: int, bit: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(whole big-endian 32-bit words, bit offset of each id from the start of the first word, last word begun, bits in it).
    `word` holds the `bit` bits that the stream ended with before."""
    size = lengths[ids].astype(np.int64)
    ends = bit + np.cumsum(size)
    starts = ends - size
    at = starts >> 5
    wide = codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
    out = np.zeros(int(ends[-1] >> 5) + 2 if len(ids) else 2, np.uint64)
    out[0] = word
    if len(ids):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[at[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    total = int(ends[-1]) if len(ids) else bit
    return out[:total >> 5].astype(">u4"), starts, int(out[total >> 5]), total & 31


def decoded(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, table_ids: np.ndarray, table_bits: np.ndarray, bits: int) -> np.ndarray:
    """Ids of blocks that begin at the given bits of `data`, one column per block, all blocks step by step together."""
    low, high = int(begins[0]) >> 3, len(data)
    raw = np.concatenate([data[low:high], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    place = begins - low * 8
    out = np.zeros((int(counts.max()), len(begins)), np.uint32)
    mask, top = np.uint32((1 << bits) - 1), len(window) - 1
    for k in range(len(out)):
        key = (window[np.minimum(place >> 3, top)] >> (32 - bits - (place & 7)).astype(np.uint32)) & mask
        out[k] = table_ids[key]
        place = place + table_bits[key]
    return out


def write_files(rows: DataFrame, width: str, lengths: np.ndarray, folder: str | None = None) -> DataFrame:
    """Writes the documents in ascending doc_id order; returns the manifest: path, partition, number, n_docs, n_tokens."""
    folder = folder or shared_folder(rows.sparkSession)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    names = ["path", "partition", "number", "n_docs", "n_tokens"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, codes = TaskContext.get(), canonical(lengths)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        made, file = [], None

        class File:
            def __init__(self) -> None:
                self.name = f"{context.partitionId():06d}-{len(made):04d}-{context.taskAttemptId()}.huf"
                self.out = fs.open_output_stream(os.path.join(base, self.name))
                self.out.write(MAGIC)
                self.docs, self.sizes, self.held, self.waiting, self.tokens, self.bits, self.word, self.bit, self.marks = [], [], [], 0, 0, 0, 0, 0, []

            def add(self, doc_id: int | None, ids: np.ndarray) -> None:
                self.docs.append(doc_id)
                self.sizes.append(len(ids))
                self.held.append(ids)
                self.waiting += len(ids)
                if self.waiting >= PART_TOKENS:
                    self.flush()

            def flush(self) -> None:
                if not self.waiting:
                    return
                whole, starts, self.word, bit = packed(np.concatenate(self.held), lengths, codes, self.word, self.bit)
                blocks = np.arange(-self.tokens % BLOCK_TOKENS, len(starts), BLOCK_TOKENS)
                self.marks.append(self.bits - self.bit + starts[blocks])
                self.bits += 32 * len(whole) + bit - self.bit
                self.bit = bit
                self.tokens += self.waiting
                self.held, self.waiting = [], 0
                self.out.write(whole.tobytes())

            def close(self) -> None:
                self.flush()
                self.out.write(struct.pack(">I", self.word))
                marks = np.concatenate(self.marks).astype("<u8").tobytes()
                null = np.array([x is None for x in self.docs], np.uint8).tobytes()
                ids = np.array([x or 0 for x in self.docs], "<i8").tobytes()
                self.out.write(lengths.astype(np.uint8).tobytes() + marks + ids + null + np.array(self.sizes, "<i8").tobytes())
                self.out.write(struct.pack(FOOTER, self.tokens, self.bits, len(self.docs), len(lengths), BLOCK_TOKENS, zlib.crc32(marks + ids), MAGIC))
                self.out.close()
                made.append((f"{folder}/{self.name}", context.partitionId(), len(made), len(self.docs), self.tokens))

        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = file or File()
                file.add(doc_id, np.frombuffer(cell.as_buffer(), width))
                if file.tokens + file.waiting >= FILE_TOKENS:
                    file.close()
                    file = None
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64() if k else pa.string()) for k in range(5)], names)

    return table(ordered.select("doc_id", "ids").mapInArrow(write, "path string, partition long, number long, n_docs long, n_tokens long"))


def read_file(raw: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, in order."""
    if len(raw) < struct.calcsize(FOOTER) + len(MAGIC) or raw[:len(MAGIC)].tobytes() != MAGIC:
        raise ValueError("not a file of this kind")
    tokens, _, docs, vocabulary, block, check, magic = struct.unpack(FOOTER, raw[-struct.calcsize(FOOTER):].tobytes())
    blocks = -(-tokens // block) if block else 0
    cuts = np.cumsum([0, vocabulary, 8 * blocks, 8 * docs, docs, 8 * docs]) + len(raw) - struct.calcsize(FOOTER) - (vocabulary + 8 * blocks + 17 * docs)
    if magic != MAGIC or cuts[0] < len(MAGIC) or zlib.crc32(raw[cuts[1]:cuts[3]].tobytes()) != check:
        raise ValueError("the file is cut short or broken")
    lengths, marks, ids, null, sizes = (raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    lengths, marks = np.frombuffer(lengths, np.uint8), np.frombuffer(marks, "<u8").astype(np.int64)
    ids, null, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(null, np.uint8), np.frombuffer(sizes, "<i8")
    if sizes.sum() != tokens:
        raise ValueError("the token counts do not add up")
    bits = max(1, int(lengths.max(initial=1)))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spread = 1 << (bits - lengths[used].astype(np.int64))
    table_ids, table_bits = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    table_ids[:spread.sum()], table_bits[:spread.sum()] = np.repeat(used, spread), np.repeat(lengths[used], spread)
    body = raw[len(MAGIC):cuts[0]]
    left, doc, pending, need = np.zeros(0, np.uint32), 0, [], int(sizes[0]) if docs else 0
    for i in range(0, blocks, SIDE_BY_SIDE):
        j = min(i + SIDE_BY_SIDE, blocks)
        counts = np.full(j - i, block)
        if j == blocks:
            counts[-1] = tokens - (blocks - 1) * block
        end = int(marks[j] >> 3) + 8 if j < blocks else len(body)
        columns = decoded(body[:end], marks[i:j], counts, table_ids, table_bits, bits)
        left = columns.T.reshape(-1)[:int(counts.sum())] if counts[-1] == len(columns) else np.concatenate([columns[:, :-1].T.reshape(-1), columns[:counts[-1], -1]])
        at = 0
        while doc < docs and len(left) - at >= need:
            pending.append(left[at:at + need])
            at += need
            yield (None if null[doc] else int(ids[doc])), pending[0] if len(pending) == 1 else np.concatenate(pending)
            doc, pending = doc + 1, []
            need = int(sizes[doc]) if doc < docs else 0
        if doc < docs and at < len(left):
            pending.append(left[at:])
            need -= len(left) - at


def read_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids of every document."""
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays(columns + [pa.array([r[4] for r in rows], pa.list_(pa.int64()))] * with_ids, names)

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(place) as stream:
                    raw = np.frombuffer(stream.read(), np.uint8)
                rows, held = [], 0
                for doc_id, ids in read_file(raw):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    start += len(ids)
                    held += len(ids) if with_ids else 16
                    if held >= PART_TOKENS:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises, counts, writes the files and reads them back."""
    rows, width = tokenised(documents, path or tokenizer_path())
    return read_files(write_files(rows, width, code_lengths(token_counts(rows, width))), with_ids)
