"""Ranked lexical search by presence masks: the best documents for each item of a stated query set.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z folded. A document's score is the sum over the item's
terms, repeats included, of the term's weight (rarer terms weigh more) times its saturated frequency, which falls with the length of
the document; all in whole numbers.

Each task reads its texts block by block. In a block every query term has a bitmap of the documents that hold it. For each item the
bitmaps of its terms are put side by side, so that each document has a mask of the item's terms in it, and documents are grouped
by mask. The most that a mask can score, each of its terms counted with the greatest frequency part it has in the block, orders
the masks; they are evaluated from the highest on, until the next cannot reach the last of the best documents found so far by
the task, in this block or before. That is safe: no document that was not evaluated could be among the best. A task sends
at most `top` documents per item, and the best of these are the result. Nothing else is shuffled.

Items are dealt by hash into blocks of about `BLOCK_TERMS` terms. Each is searched and its result written before the next is broadcast; the
documents are read twice per block (document counts of the terms first). Query terms are found by an exact dictionary.

Rows: a null, empty or termless text of an item or a document matches nothing. Rows equal in item_id and text are one item; other texts
of one item_id are items of their own, each ranked from 1. A null item_id or doc_id is passed through; of equal scores null comes
last, and rows of equal doc_id are ranked in any order. Texts are read whole. Other columns are not read. An empty
table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretally.llm.blocks import LOWER, row_of, text_blocks
from caretally.llm.store import table

TOP = 10
#: Terms, repeats included, of the items that are broadcast at a time, about.
BLOCK_TERMS = 500_000
#: Bytes of text whose documents share bitmaps.
BLOCK_BYTES = 8 << 20
#: All bitmaps of a block take about so many bytes at most.
BITMAP_BYTES = 8 << 20
#: The document length counts for so many percent.
LENGTH_PERCENT = 75
IN_TERM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The folded terms of the texts, and the row of each."""
    inside = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts, ends = np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    packed = LOWER[data[inside]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]), row_of(offsets, starts)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, text and n_terms of every distinct item that has a term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                number = np.bincount(terms(data, offsets)[1], minlength=j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(2)), pa.array(number)], ["item_id", "text", "n_terms"])

    distinct = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    return distinct.mapInArrow(work, "item_id long, text string, n_terms long").where("n_terms > 0")


def numbered_items(block: pa.Table) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The distinct terms of a block of items, and per item the numbers of its terms and how often each occurs in it."""
    found, rows, before = [], [], 0
    for batch in block.to_batches():
        for i, _, data, offsets in text_blocks(batch, "text"):
            words, row = terms(data, offsets)
            found.append(words)
            rows.append(row + i + before)
        before += len(batch)
    coded = pc.dictionary_encode(pa.concat_arrays(found))
    pairs, times = np.unique(np.concatenate(rows) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
    owner, code = pairs // len(coded.dictionary), pairs % len(coded.dictionary)
    cuts = np.searchsorted(owner, np.arange(1, block.num_rows))
    return coded.dictionary, np.split(code, cuts), np.split(times, cuts)


def postings(vocabulary: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, times) of the query terms in the texts, by term and then row, and each text's number of terms."""
    words, rows = terms(data, offsets)
    n = len(offsets) - 1
    code = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy().astype(np.int64)
    pairs, times = np.unique(code[code >= 0] * n + rows[code >= 0], return_counts=True)
    return pairs // n, pairs % n, times, np.bincount(rows, minlength=n)


class Best:
    """The best documents of each item so far: score, doc_id, and whether that is null."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items

    def least(self, item: int) -> int:
        """A score below which no document of this item matters."""
        score = self.found[item][0]
        return int(score[self.top - 1]) if len(score) >= self.top else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = map(np.concatenate, zip(self.found[item], (score, doc, null), strict=True))
        order = np.lexsort((doc, null, -score))[:self.top]
        order = order[score[order] > 0]
        self.found[item] = score[order], doc[order], null[order]


def masks_of(bitmaps: np.ndarray, n: int) -> np.ndarray:
    """Per document of a block the mask of the terms it holds, as one number per 64 terms; `bitmaps` has a row of bits per term."""
    k = len(bitmaps)
    bits = np.zeros((-(-k // 64) * 64, n), np.uint8)
    bits[:k] = np.unpackbits(bitmaps, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def search_block(best: Best, doc: np.ndarray, null: np.ndarray, found: tuple[np.ndarray, ...], queries: tuple, weights: np.ndarray, total: int, documents: int) -> None:
    """Brings the best documents of every item up to date with one block of texts."""
    term, row, times, lengths = found
    n = len(doc)
    share = 100 - LENGTH_PERCENT + np.array([LENGTH_PERCENT * x * documents // total for x in lengths.tolist()], np.int64)
    part = 1_000_000_000 * times // (1000 * times + 8 * share[row])
    first = np.searchsorted(term, np.arange(len(weights) + 1))
    most = np.zeros(len(weights), np.int64)
    np.maximum.at(most, term, part)
    bitmaps = np.zeros((len(weights), -(-n // 8)), np.uint8)
    np.bitwise_or.at(bitmaps, (term, row >> 3), np.uint8(1) << (row & 7).astype(np.uint8))
    key = term * n + row
    for item, (codes, repeats) in enumerate(zip(*queries, strict=True)):
        own = first[codes + 1] > first[codes]
        codes, factor = codes[own], (weights[codes] * repeats)[own]
        if not len(codes):
            continue
        mask = masks_of(bitmaps[codes], n)
        kinds, group, size = np.unique(mask[:, 0], return_inverse=True, return_counts=True) if mask.shape[1] == 1 else np.unique(mask, axis=0, return_inverse=True, return_counts=True)
        held = np.unpackbits(np.ascontiguousarray(kinds).view(np.uint8).reshape(len(kinds), -1), axis=1, count=len(codes), bitorder="little").astype(np.int64)
        highest = held @ (factor * most[codes])
        order = np.argsort(-highest, kind="stable")
        order = order[highest[order] >= best.least(item)]
        rank = np.full(len(kinds), -1)
        rank[order] = np.arange(len(order))
        place = rank[group]
        chosen = np.flatnonzero(place >= 0)
        chosen = chosen[np.argsort(place[chosen], kind="stable")]
        ends, a = np.cumsum(size[order]), 0
        while a < len(order) and highest[order[a]] >= best.least(item):
            begin = int(ends[a] - size[order[a]])
            b = max(a + 1, int(np.searchsorted(ends, begin + 64, "right")))  # several small masks together
            rows = chosen[begin:int(ends[b - 1])]
            at = np.searchsorted(key, codes * n + rows[:, None])
            hit = held[group[rows]].astype(bool)
            score = np.where(hit, part[np.where(hit, at, 0)] * factor, 0).sum(1)
            best.add(item, score, doc[rows], null[rows])
            a = b


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, whether that is null, bytes and offsets of blocks of at most so many texts."""
    for batch in batches:
        null, doc = batch.column(0).is_null().to_numpy(zero_copy_only=False), pc.fill_null(batch.column(0), 0).to_numpy()
        for i, j, data, offsets in text_blocks(batch, "text", BLOCK_BYTES):
            for a in range(0, j - i, most):
                cuts = offsets[a:a + most + 1]
                own = slice(i + a, i + a + len(cuts) - 1)
                yield doc[own], null[own], data[cuts[0]:cuts[-1]], cuts - cuts[0]


def texts_at_once(vocabulary: pa.Array) -> int:
    return max(64, 8 * BITMAP_BYTES // len(vocabulary))


def counts(texts: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, int, int]:
    """The number of documents that hold each query term, of documents with a term at all, and of all their terms."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(len(shared.value) + 2, np.int64)
        for _, _, data, offsets in blocks_of(batches, texts_at_once(shared.value)):
            term, _, _, lengths = postings(shared.value, data, offsets)
            number[:-2] += np.bincount(term, minlength=len(shared.value))
            number[-2:] += np.count_nonzero(lengths), lengths.sum()
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(number[used])], ["term", "n"])

    number = np.zeros(len(vocabulary) + 2, np.int64)
    for r in texts.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a block's terms
        number[r["term"]] = r["n"]
    shared.unpersist()
    return number[:-2], int(number[-2]), int(number[-1])


def searched(texts: DataFrame, block: pa.Table, top: int) -> DataFrame:
    """item (the place in the block), item_id, doc_id and score: the best documents of each item, of every task."""
    vocabulary, codes, repeats = numbered_items(block)
    df, documents, total = counts(texts, vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    ids = block["item_id"].combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, codes, repeats, weights, ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, codes, repeats, weights, ids = shared.value
        best = Best(len(codes), top)
        for doc, null, data, offsets in blocks_of(batches, texts_at_once(vocabulary)):
            search_block(best, doc, null, postings(vocabulary, data, offsets), (codes, repeats), weights, max(total, 1), documents)
        item = np.repeat(np.arange(len(codes)), [len(x[0]) for x in best.found])
        score, doc, null = map(np.concatenate, zip(*best.found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(item)), pa.array(doc, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return texts.mapInArrow(work, "item long, item_id long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item (fewer, where fewer score above 0)."""
    texts, queries = documents.select("doc_id", "text"), table(item_terms(items))
    blocks = -(-(queries.agg(F.sum("n_terms")).first()[0] or 0) // BLOCK_TERMS)
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").toArrow()  # a bounded block
        if not len(block):
            continue
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = searched(texts, block, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = table(best.select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM t) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
x AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS score
      FROM q JOIN df USING (w) JOIN tf USING (w) JOIN n USING (doc_id), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 10
"""
