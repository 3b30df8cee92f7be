"""Benchmark decontamination: short test items searched inside long documents.

An item matches a document if at least `THRESHOLD` percent of its distinct five-word shingles (A-Z folded) stand anywhere in
the document. Items are partitioned by size (powers of two of their shingle count). An item's sketch is its k smallest
shingle hashes, where k = floor(25 % of the partition's largest size) + 1: a document with three quarters of an item's
shingles must hold one of them, however long it is, so the search loses nothing. A document is probed against the sketches of
the partitions that it is large enough for; the candidates are verified by the exact containment of their whole shingle sets.

Items are the stated query set. They are dealt by a hash into blocks of about `BLOCK_SHINGLES` shingles. Each is broadcast and its result
written before the one after the next is fetched, so that the driver holds two at most; every document is read once per block.
Nothing is shuffled.

Rows: an item without words, or with null text or id, matches nothing; one of fewer than five words has its whole sequence as its one
shingle and matches where that sequence stands. Documents with null or empty text match nothing; null doc_ids are passed
through. Repeated items and repeated documents give repeated pairs only for repeated documents (items are made distinct).
Other columns are not read. An empty table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.llm.blocks import SHINGLE, distinct_by_row, gram_hashes, list_array, shingle_hashes, text_blocks, word_hashes
from caretally.llm.store import sent, table

#: Percent of an item's shingles that a document has to hold.
THRESHOLD = 75
#: Shingles of the items that are broadcast at a time, about.
BLOCK_SHINGLES = 1_000_000
PAIRS = "doc_id long, item_id long, n_shared long, n_item_shingles long, containment double"


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, words, shingles): the number of words, at most five, and the sorted distinct shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                words, rows, _, _ = word_hashes(data, offsets)
                values, cuts = distinct_by_row(*shingle_hashes(words, rows), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.minimum(np.bincount(rows, minlength=j - i), SHINGLE)), list_array(values, cuts)], ["item_id", "words", "shingles"])

    distinct = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    return distinct.mapInArrow(work, "item_id long, words long, shingles array<long>").where("words > 0")


class Index:
    """Sketches and whole shingle sets of one block of items."""

    def __init__(self, items: pa.Table):
        lists = items["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.ids = items["item_id"].to_numpy()
        self.cuts = np.asarray(lists.offsets, np.int64)
        self.values = np.asarray(lists.values, np.int64)
        self.sizes = np.diff(self.cuts)
        self.lengths = sorted({int(x) for x in items["words"].to_numpy()} - {SHINGLE})
        part = np.frexp(self.sizes.astype(float))[1]  # size < 2 ** part
        self.least = (THRESHOLD * (1 << np.maximum(part - 1, 0)) + 99) // 100
        keys, owners = [], []
        for k, size in enumerate(self.sizes):
            keep = min(int(size), (100 - THRESHOLD) * ((1 << int(part[k])) - 1) // 100 + 1)
            keys.append(self.values[self.cuts[k]:self.cuts[k] + keep])
            owners.append(np.full(keep, k))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.owners, self.first = owners[order], np.append(first, len(keys))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of all matches in a block of texts."""
        words, rows, _, _ = word_hashes(data, offsets)
        grams = [gram_hashes(words, rows, n) for n in (*self.lengths, SHINGLE)]
        values = np.concatenate([v for v, _ in grams]).view(np.int64)
        owner = np.concatenate([rows[f] for _, f in grams])
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hit = self.keys[at] == values
        number = np.diff(self.first)[at[hit]]
        pair_row = np.repeat(owner[hit], number)
        starts = np.repeat(self.first[at[hit]], number)
        item = self.owners[starts + np.arange(len(starts)) - np.repeat(np.cumsum(number) - number, number)]
        candidates = np.unique(pair_row * len(self.ids) + item)
        for row in np.unique(candidates // len(self.ids)):
            own = np.unique(values[owner == row] if len(grams) > 1 else values[np.searchsorted(owner, row):np.searchsorted(owner, row, "right")])
            for k in candidates[candidates // len(self.ids) == row] % len(self.ids):
                if len(own) < self.least[k]:
                    continue
                whole = self.values[self.cuts[k]:self.cuts[k + 1]]
                place = np.minimum(np.searchsorted(own, whole), len(own) - 1)
                shared = int((own[place] == whole).sum())
                if 100 * shared >= THRESHOLD * len(whole):
                    yield int(row), int(k), shared


def indexes(items: DataFrame) -> Iterator[Index]:
    """The items as indexes of bounded size, one after another."""
    sets = table(item_sets(items))
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for b in range(blocks):
        block = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).orderBy("item_id", F.col("shingles")[0]).toArrow()  # a bounded block
        if len(block):
            yield Index(block)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item_shingles, containment of every match."""
    spark = documents.sparkSession
    texts, out = documents.select("doc_id", "text"), None
    for index in indexes(benchmark):
        made = sent(spark, index)

        def work(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            index = made()
            for batch in batches:
                for i, _, data, offsets in text_blocks(batch, "text"):
                    found = list(index.matches(data, offsets))
                    rows, items, n = (np.array([x[c] for x in found], np.int64) for c in range(3))
                    whole = index.sizes[items]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + i)), pa.array(index.ids[items]), pa.array(n), pa.array(whole), pa.array(n / np.maximum(whole, 1))],
                                                     ["doc_id", "item_id", "n_shared", "n_item_shingles", "containment"])

        found = table(texts.mapInArrow(work, PAIRS))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    for block, index in enumerate(indexes(benchmark)):
        if block:
            documents = table(documents)
        made = sent(documents.sparkSession, index)

        def work(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            index = made()
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, _, data, offsets in text_blocks(batch, "text"):
                    keep[[i + row for row, _, _ in index.matches(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(work, documents.schema)
    return documents


ORACLE = r"""
WITH b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM b),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
bn AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item_shingles, n_shared / n_item_shingles AS containment
FROM m JOIN bn USING (item_id) WHERE 100 * n_shared >= 75 * n_item_shingles
"""
