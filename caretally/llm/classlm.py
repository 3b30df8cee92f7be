"""Language-model scores by Brown class-based bigrams.

Tokens are words (A-Z folded) and one end per text. The probability of a token is that of its class behind the class of the token
before (the end of a text stands before its first token), times that of the token within its class.

1. Words are counted over all training texts. The `CLUSTERED` most frequent ones (cut where a step of the count scale ends; words that occur
   once never) are put into `CLASSES` classes. The end is a class of its own, and so are all other words, known or not.
2. Neighbours are counted over all training texts, into one list of the words behind and before each word.
3. Exchange clustering: each word is taken out of its class and put where the likelihood of all class bigrams grows most. In one
   sweep half of the words, by a hash of their number, choose at the same time, by the class bigrams at its start; the result does
   not depend on partitions. Lists stay where they are; only the classes go out and the choices come back.
4. Class bigrams are counted from the lists. Transitions are smoothed towards the classes' frequencies. A word's share of its
   class is its count over the class's; among the other words it is (count + 0.5), with one unknown word beside them, so that the
   model's probabilities of all V + 1 words sum to 1 behind any word.
5. Texts are scored with the clustered words broadcast (a fixed bound). Other words are sent, once per text, to a join with the word counts.

The vocabulary, the counts and the neighbour lists grow with the corpus and stay in tables; the driver holds arrays of at most
CLUSTERED words and CLASSES * CLASSES numbers. Words are told apart by 64-bit hashes. Lists of the most frequent words are kept in parts.

Rows: a null, empty or blank text is its end alone. A null doc_id counts as held out and is passed through; repeated rows are scored alike,
each learnt from. Texts are read whole, block by block. Without training rows every score is 0. Only doc_id and text are read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.llm.blocks import mix, text_blocks, word_hashes
from caretally.llm.store import table

#: Words that are clustered, at most, and classes that they are put into.
CLUSTERED, CLASSES = 1 << 17, 64
#: Half-sweeps of the exchange.
SWEEPS = 6
#: Tokens of the classes' frequencies that smooth the transitions behind each class.
PRIOR = 50.0
#: Numbers of the end and of all words that are not clustered; clustered ones follow by frequency. The same for classes.
END, OTHER, FIRST = 0, 1, 2
#: The neighbours of so many first words are kept in parts of PART words.
FREQUENT, PART = 256, 4096
#: Distinct keys that a task gathers before it sends them on.
GATHERED = 2_000_000
#: A neighbour's number, its side (0 behind, 1 before) and its count share 32 bits.
BITS = 18
COUNT = (1 << (31 - BITS)) - 1


def held_out(doc_id: Column) -> Column:
    """True for the rows that the model may not learn from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(True))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Tally:
    """Counts of keys, merged from time to time."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Counts the keys; true if there are so many that they should be sent on."""
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size < GATHERED:
            return False
        self.parts = [summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])
        return self.size >= GATHERED // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(*map(np.concatenate, zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, np.int64),) * 2
        self.parts, self.size = [], 0
        return out


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of every token; the end has a null key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, ends = Tally(), 0
        for batch in batches:
            ends += len(batch)
            for _, _, data, offsets in text_blocks(batch, "text"):
                if tally.add(word_hashes(data, offsets)[0].view(np.int64)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.take()], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.take()], ["key", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends])], ["key", "n"])

    return texts.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The clustered words, from the most frequent on: hash and count; and the counts of the rest."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]

    def __len__(self) -> int:
        return FIRST + len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, OTHER if it is not clustered."""
        if not len(self.keys):
            return np.full(len(keys), OTHER)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at] + FIRST, OTHER)


def frequent_words(vocabulary: DataFrame, most: int = CLUSTERED) -> Words:
    """The words to cluster: whole steps of the count scale, 16 to the octave, from the top as far as there is room."""
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0))).first()
    step = F.floor(F.log2("n") * 16)
    words, lowest, room = vocabulary.where("key IS NOT NULL AND n > 1"), None, most
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 per octave
        room -= r["count"]
        if room < 0:
            break
        lowest = r["step"]
    found = words.where(step >= lowest).toArrow() if lowest is not None else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})  # at most CLUSTERED rows
    keys, counts = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.lexsort((keys, -counts))
    return Words(keys[order], counts[order], int(total[0]), int(total[1]), int(total[2]))


def sequences(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers and hashes of the tokens of the texts, an end behind each text, and the row of each token."""
    n = len(offsets) - 1
    keys, rows, _, _ = word_hashes(data, offsets)
    place = np.arange(len(keys)) + rows
    line, hashes, row = np.zeros(len(keys) + n, np.int64), np.zeros(len(keys) + n, np.int64), np.zeros(len(keys) + n, np.int64)
    line[place], hashes[place], row[place] = words.numbers(keys.view(np.int64)), keys.view(np.int64), rows
    ends = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    line[ends], row[ends] = END, np.arange(n)
    return line, hashes, row


# --- neighbour lists ---------------------------------------------------------


def part_of(word: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.where(word < FREQUENT, other // PART, 0)


def packed_lists(word: np.ndarray, side: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (word, part, cells), sorted, of the given entries; a count too large for a cell takes several."""
    order = np.lexsort((other, side, part_of(word, other), word))
    word, side, other, n = (x[order] for x in (word, side, other, n))
    times = (n - 1) // COUNT + 1
    last = np.cumsum(times) - 1
    rest = n - (times - 1) * COUNT
    word, side, other = (np.repeat(x, times) for x in (word, side, other))
    n = np.full(len(word), COUNT)
    n[last] = rest
    part = part_of(word, other)
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (part[1:] != part[:-1]))) if len(word) else np.zeros(0, np.int64)
    cells = (other | side << BITS | n << (BITS + 1)).astype("<u4")
    bounds = (np.append(first, len(word)) * 4).astype(np.int32)
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(cells)])
    return pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(part[first].astype(np.int32)), lists], ["word", "part", "cells"])


def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The word, the side, the neighbour and the count of every cell."""
    cells = batch.column(batch.schema.get_field_index("cells")).cast(pa.large_binary())
    if not len(cells):
        return (np.zeros(0, np.int64),) * 4
    bounds = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
    flat = np.frombuffer(cells.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].view("<u4").astype(np.int64)
    word = np.repeat(batch.column(batch.schema.get_field_index("word")).to_numpy().astype(np.int64), np.diff(bounds) // 4)
    return word, flat >> BITS & 1, flat & ((1 << BITS) - 1), flat >> (BITS + 1)


LISTS = "word int, part int, cells binary"


def neighbour_lists(texts: DataFrame, words: Words) -> DataFrame:
    """The neighbours of each word, one row per word and part, all of them."""
    shared, width = texts.sparkSession.sparkContext.broadcast((words.keys, words.counts)), len(words)

    def lists(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        before, behind = codes // width, codes % width
        batch = packed_lists(np.concatenate([before, behind]), np.repeat([0, 1], len(codes)), np.concatenate([behind, before]), np.concatenate([n, n]))
        for a in range(0, len(batch), 20_000):
            yield batch.slice(a, 20_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = Words(*shared.value, 0, 0, 0), Tally()
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch, "text"):
                line, _, _ = sequences(known, data, offsets)
                if tally.add(np.append(END, line[:-1]) * width + line):
                    yield from lists(*tally.take())
        yield from lists(*tally.take())

    def added(word: np.ndarray, side: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        codes, n = summed((word << (BITS + 1)) + (side << BITS) + other, n)
        return packed_lists(codes >> (BITS + 1), codes >> BITS & 1, codes & ((1 << BITS) - 1), n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up consecutive rows of equal word and part; the last ones of a batch wait for the next."""
        held = (np.zeros(0, np.int64),) * 4
        for batch in batches:
            if not len(batch):
                continue
            held = tuple(map(np.concatenate, zip(held, cells_of(batch), strict=True)))
            wait = (held[0] == batch.column(0)[len(batch) - 1].as_py()) & (part_of(held[0], held[2]) == batch.column(1)[len(batch) - 1].as_py())
            yield added(*(x[~wait] for x in held))
            held = tuple(x[wait] for x in held)
        yield added(*held)

    dealt = texts.select("text").mapInArrow(work, LISTS).repartition("word", "part").sortWithinPartitions("word", "part")
    return table(dealt.mapInArrow(merge, LISTS))


# --- exchange ----------------------------------------------------------------


def class_vectors(batch: pa.RecordBatch, classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a batch, and how often each class stands behind and before each of them."""
    word, side, other, n = cells_of(batch)
    words, back = np.unique(word, return_inverse=True)
    code = (back * 2 + side) * width + classes[other]
    return words, np.bincount(code, weights=n, minlength=len(words) * 2 * width).astype(np.int64).reshape(len(words), 2, width)


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(vectors: np.ndarray, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class in which each word makes the class bigrams most likely: its own on a tie, else the first."""
    out = own.copy()
    classes = np.arange(FIRST, bigrams.shape[0])
    for a in range(0, len(own), 250):
        part, mine = vectors[a:a + 250].astype(float), own[a:a + 250]
        gain, stay = np.zeros((len(part), len(classes))), np.zeros(len(part))
        for side, matrix in ((0, bigrams), (1, bigrams.T)):
            rows = matrix[FIRST:].astype(float)
            word, c = np.nonzero(part[:, side])
            n = part[word, side, c]
            there = rows[:, c].T
            gained = entropy(there + n[:, None]) - entropy(there)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            if len(first):
                gain[word[first]] += np.add.reduceat(gained, first, axis=0)
            here = rows[mine[word] - FIRST, c]
            np.add.at(stay, word, entropy(here) - entropy(np.maximum(here - n, 0)))
            total, all_ = part[:, side].sum(1), rows.sum(1)
            gain -= entropy(all_ + total[:, None]) - entropy(all_)
            at = all_[mine - FIRST]
            stay -= entropy(at) - entropy(np.maximum(at - total, 0))
        gain[np.arange(len(part)), mine - FIRST] = stay
        best = np.argmax(gain, 1)
        better = gain[np.arange(len(part)), best] > stay + 1e-9 * np.abs(stay)
        out[a:a + 250] = np.where(better, classes[best], mine)
    return out


def class_bigrams(lists: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """How often each class stands behind each class."""
    shared = lists.sparkSession.sparkContext.broadcast(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            word, side, other, n = cells_of(batch)
            word, other, n = (x[side == 0] for x in (word, other, n))
            total += np.bincount(shared.value[word] * width + shared.value[other], weights=n, minlength=width * width).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])

    out = np.zeros(width * width, np.int64)
    for r in lists.select("word", "cells").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most width * width
        out[r["code"]] = r["n"]
    shared.unpersist()
    return out.reshape(width, width)


def sweep(lists: DataFrame, classes: np.ndarray, bigrams: np.ndarray, turn: int) -> np.ndarray:
    """The classes after the words of this turn have chosen anew."""
    shared, width = lists.sparkSession.sparkContext.broadcast((classes, bigrams)), len(bigrams)

    def moving(words: np.ndarray) -> np.ndarray:
        return (words >= FIRST) & (mix(words.astype(np.uint64)) % np.uint64(2) == np.uint64(turn % 2))

    def choose(words: np.ndarray, vectors: np.ndarray, classes: np.ndarray, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        go = moving(words)
        best = best_classes(vectors[go], classes[words[go]], bigrams)
        other = best != classes[words[go]]
        return words[go][other], best[other]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Choices of the words that are whole in their row, and the vectors of those that are kept in parts."""
        classes, bigrams = shared.value
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                words, vectors = class_vectors(batch.slice(k, 2_000), classes, width)
                split = words < FREQUENT
                own = split & moving(words)
                yield pa.RecordBatch.from_arrays([pa.array(words[own].astype(np.int32)), pa.array(np.full(own.sum(), -1, np.int32)), pa.array([v.tobytes() for v in vectors[own]], pa.binary())], ["word", "class", "vector"])
                yield rows(*choose(words[~split], vectors[~split], classes, bigrams))

    def rows(words: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(best.astype(np.int32)), pa.nulls(len(words), pa.binary())], ["word", "class", "vector"])

    out, parts = classes.copy(), {}
    found = lists.mapInArrow(work, "word int, class int, vector binary").toArrow()  # at most CLUSTERED rows, and FREQUENT words in parts
    for w, c, v in zip(*(found[x].to_pylist() for x in ("word", "class", "vector")), strict=True):
        if v is None:
            out[w] = c
        else:
            parts[w] = parts.get(w, 0) + np.frombuffer(v, np.int64).reshape(2, width)
    if parts:
        words = np.array(sorted(parts))
        moved, best = choose(words, np.stack([parts[w] for w in words.tolist()]), classes, bigrams)
        out[moved] = best
    shared.unpersist()
    return out


# --- model -------------------------------------------------------------------


@dataclass
class Model:
    """Clustered words with their classes, the class bigrams, and the table (key, n) of all words."""

    words: Words
    classes: np.ndarray
    bigrams: np.ndarray
    vocabulary: DataFrame

    def transitions(self) -> np.ndarray:
        """log10 probability of each class (column) behind each class (row)."""
        if not self.words.tokens:
            return np.zeros(self.bigrams.shape)
        used = np.bincount(self.classes, minlength=len(self.bigrams)) > 0
        share = (self.bigrams.sum(0) + 1.0) * used
        rows = self.bigrams + PRIOR * share / share.sum()
        with np.errstate(divide="ignore"):
            return np.log10(rows / rows.sum(1, keepdims=True))

    def emissions(self) -> np.ndarray:
        """log10 share of each clustered word in its class; 0 for the end and for the others as a whole."""
        counts = np.concatenate([[1, 1], self.words.counts]).astype(float)
        total = np.bincount(self.classes, weights=counts, minlength=len(self.bigrams))
        return np.log10(counts / total[self.classes])

    def other_words(self) -> tuple[int, int]:
        """Tokens and distinct words that are not clustered."""
        return self.words.tokens - self.words.ends - int(self.words.counts.sum()), self.words.distinct - (self.words.ends > 0) - len(self.words.keys)


def fit(texts: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, sweeps: int = SWEEPS) -> Model:
    """The model of all given texts."""
    vocabulary = table(token_counts(texts))
    words = frequent_words(vocabulary, clustered)
    width = FIRST + min(classes, max(1, len(words.keys)))
    chosen = np.concatenate([[END, OTHER], FIRST + np.arange(len(words.keys)) % (width - FIRST)])
    lists = neighbour_lists(texts, words)
    bigrams = class_bigrams(lists, chosen, width)
    for turn in range(sweeps if len(words.keys) else 0):
        chosen = sweep(lists, chosen, bigrams, turn)
        bigrams = class_bigrams(lists, chosen, width)
    return Model(words, chosen, bigrams, vocabulary)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (the smoothed word frequencies'), score (the model's log10 probability) and perplexity."""
    words = model.words
    floor = words.tokens + 0.5 * (words.distinct + 1)
    base = np.log10((np.concatenate([[words.ends, 0], words.counts]) + 0.5) / floor)
    base[OTHER] = 0.0
    tokens, distinct = model.other_words()
    shared = documents.sparkSession.sparkContext.broadcast((words.keys, words.counts, words.ends > 0, model.classes, model.transitions(), model.emissions(), base))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, ended, classes, transition, emission, base = shared.value
        known, at = Words(keys, counts, 0, 0, 0), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                n = j - i
                line, hashes, row = sequences(known, data, offsets)
                c = classes[line]
                gained = transition[np.append(END, c[:-1]), c] + emission[line]
                size = np.bincount(row, minlength=n)
                rest = line == OTHER
                unknown, times = np.unique(np.stack([row[rest], hashes[rest]], 1), axis=0, return_counts=True) if rest.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                cuts = np.searchsorted(unknown[:, 0], np.arange(n + 1)).astype(np.int32)
                cells = pa.StructArray.from_arrays([pa.array(unknown[:, 1]), pa.array(times.astype(np.int64))], ["key", "times"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + np.arange(n)), batch.column(0).slice(i, n), pa.array(size), pa.array(np.bincount(row, weights=~rest, minlength=n).astype(np.int64) - (not ended)),
                     pa.array(np.bincount(row, weights=base[line], minlength=n)), pa.array(np.bincount(row, weights=gained, minlength=n)), pa.ListArray.from_arrays(pa.array(cuts), cells)],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])
                at += n

    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<struct<key: long, times: long>>"
    part = table(documents.select("doc_id", "text").mapInArrow(work, schema))
    found = part.select("row", F.explode("rest").alias("w")).select("row", "w.key", "w.times").join(model.vocabulary, "key", "left")
    n = F.coalesce("n", F.lit(0))
    rest = found.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(floor))).alias("_base"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))).alias("_score"))
    whole = {c: F.col(c) + F.coalesce(extra, F.lit(0)) for c, extra in (("n_known", "_known"), ("base_score", "_base"), ("score", "_score"))}
    out = part.drop("rest").join(rest, "row", "left").withColumns(whole)
    return out.select("doc_id", "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document, by a model of the rows that
    are not held out."""
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    found = score(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
