"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two strings of letters by their common subsequences of three letters, which may have gaps: a subsequence that
spans s letters counts `DECAY` ** s, up to `SPAN` letters. Anything but letters (digits, punctuation, symbols) is passed over, so
characters put between the letters of an insult change nothing, and letters put in cost no more than the decay of the gap. Strings are the
words of a sentence and its overlapping runs of up to `RUN` neighbouring words, joined across the blanks; neighbouring words of one letter
are read together. A string's weight is divided by a norm of its length alone.

Landmarks are strings of the training sentences; a string's Nyström features are its kernel values with them, whitened by the
landmarks' own kernel matrix. A linear support vector machine on these features (squared hinge, solved exactly by Newton steps) gives
each string a margin; it learns from the sentences of labelled documents in the multiple-instance way: strings of sentences in clean
documents are negative; in toxic ones, strings that speak for toxicity by how many distinct sentences have them are positive, runs only
if no part of them speaks by itself. Where too few labels are there for any string to speak, those nearest to it do. A
document's probability is a logistic function, fitted on labelled documents set apart, of the margins of its worst words (a run
that is toxic while none of its words is counts as a word in parts), those of its worst runs by their own machine, and the number of its words.

There are two machines, one of words (it also sees the runs, for insults broken into parts) and one of longer runs. As the kernel is a sum
over subsequences, a machine is a single table of weights per three letters, so scoring costs the same for any number of landmarks, and it runs over whole texts, some MB at a time.

Rows: null, empty and letterless texts score as a document without a word. Without labels of both kinds the score is the
share of toxic labels (0 if none). Labels with a null doc_id or value are left out, rows with equal doc_id are scored each by itself, and only
doc_id and text (for training, labels.toxic) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretally.llm.blocks import Spans, mix, pieces, row_of, space_table
from caretally.llm.store import sent
from caretally.llm.langid import held_out

#: The sample learnt from: so many toxic and clean documents at most, by a hash of doc_id, none longer than so many characters.
TOXIC_DOCUMENTS, CLEAN_DOCUMENTS, LONGEST = 1_500, 2_500, 20_000
LANDMARKS = 96
SPAN, DECAY = 5, 0.6
#: Every third document of the sample is set apart for the logistic function, if it has enough toxic ones.
APART, ENOUGH = 3, 300
#: The log-likelihood ratio statistic from which a word speaks for toxicity.
SURPRISE = 14
#: Words of clean documents that the machine learns from.
NEGATIVES = 30_000
#: Words of a document that count, the worst ones, as far as their margin is above FLOOR.
WORST = 4
#: Neighbouring words of a sentence that are read as one string, at most. Runs do not cross the pieces (some MB) of a long text.
RUN = 3
FLOOR = -0.5
REGULAR = 1e-3
#: Texts of the sample that are read at a time.
SLICE = 200
CLASSES = 32

#: Classes of bytes: 1-26 letters, 27-31 bytes that continue a character beyond ASCII, 0 what is passed over.
BYTE_CLASS = np.zeros(256, np.int64)
BYTE_CLASS[97:123] = BYTE_CLASS[65:91] = np.arange(1, 27)
BYTE_CLASS[128:192] = 27 + np.arange(64) % 32 % 5
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


class Words:
    """The words of a piece: classes of their letters, the word of each letter, and row and sentence of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = space_table()[data]
        cls = BYTE_CLASS[data]
        at = np.flatnonzero((cls > 0) & ~space)
        self.cls = cls[at]
        row = row_of(offsets, at)
        gap = np.cumsum(space)[at]
        stop = np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10))[at]
        new = np.ones(len(at), bool)
        new[1:] = (gap[1:] != gap[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        letters = np.diff(np.append(first, len(at)))
        # Words of one letter join the word before them if that has one letter too.
        joins = np.zeros(len(first), bool)
        joins[1:] = (letters[1:] == 1) & (letters[:-1] == 1) & (row[first[1:]] == row[first[:-1]]) & (stop[first[1:]] == stop[first[:-1]])
        new[first[joins]] = False
        self.first = np.flatnonzero(new)
        self.word = np.cumsum(new) - 1
        self.size = np.diff(np.append(self.first, len(at)))
        self.row, self.sentence = row[self.first], stop[self.first]
        self.at = at


def norms(size: np.ndarray) -> np.ndarray:
    """The norm of a word of so many letters as if all its subsequences differed."""
    total = np.zeros(len(size))
    for _, b in PAIRS:
        total += np.maximum(size - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def subsequences(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, index of the three letters, weight) for each way to place three letters."""
    c, w = words.cls, words.word
    for a, b in PAIRS:
        if len(c) > b:
            own = np.flatnonzero(w[:-b] == w[b:])
            yield w[own], (c[own] * CLASSES + c[own + a]) * CLASSES + c[own + b], DECAY ** (b + 1)


def runs(words: Words) -> list[np.ndarray]:
    """The first words of all runs of 1, 2 and so on up to RUN words of a sentence."""
    out = [np.arange(len(words.first))]
    for m in range(1, RUN):
        k = out[0][:max(0, len(out[0]) - m)]
        out.append(k[(words.row[k] == words.row[k + m]) & (words.sentence[k] == words.sentence[k + m])])
    return out


def margins(words: Words, table: np.ndarray, bias: float) -> list[np.ndarray]:
    """A machine's values of the runs of each length; strings of fewer than three letters have none to compare."""
    c, w, n = words.cls, words.word, len(words.first)
    parts = np.zeros((RUN, n))  # by the number of blanks that the three letters span, at their first word
    for a, b in PAIRS:
        if len(c) > b:
            m = len(c) - b
            value, over = table[(c[:m] * CLASSES + c[a:a + m]) * CLASSES + c[b:]], w[b:] - w[:m]
            for k in range(RUN):
                own = np.flatnonzero(over == k)
                parts[k] += DECAY ** (b + 1) * np.bincount(w[own], weights=value[own], minlength=n)
    out = []
    for m, first in enumerate(runs(words)):
        total, size = np.zeros(len(first)), np.zeros(len(first), np.int64)
        for start in range(m + 1):
            size += words.size[first + start]
            for over in range(m + 1 - start):
                total += parts[over][first + start]
        value = np.where(size > 2, total / norms(size) + bias, FLOOR)
        out.append(value)
    return out


def worst(words: Words, machines: list[tuple[np.ndarray, float] | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and values above FLOOR: of words, and runs on the toxic side whose words are all on the clean side (parts of one word); and of runs by their own machine."""
    starts = runs(words)
    row = [words.row[first] for first in starts]
    none = (np.zeros(0, np.int64), np.zeros(0))
    out = [none, none]
    if machines[0]:
        value = margins(words, *machines[0])
        for m in range(1, RUN):
            value[m][(value[m] < 0) | (np.max([value[0][starts[m] + k] for k in range(m + 1)], axis=0) >= 0)] = FLOOR
        out[0] = np.concatenate(row), np.concatenate(value)
    if machines[1]:
        out[1] = np.concatenate(row[1:]), np.concatenate(margins(words, *machines[1])[1:])
    return [(r[v > FLOOR], v[v > FLOOR]) for r, v in out]


def top(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The WORST greatest values of each row, in descending order."""
    out = np.full((n, WORST), FLOOR)
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < WORST
    out[row[keep], rank[keep]] = np.maximum(value[keep], FLOOR)
    return out


def features(tops: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """What the logistic function sees: the worst words and runs, and how many words there were to find them in."""
    return np.hstack([*tops, np.log1p(words)[:, None], np.ones((len(words), 1))])


def sliced(raw: list[bytes]) -> Iterator[tuple[int, int, Words]]:
    """Number of the first text, number of texts, and words, of some texts at a time."""
    for i in range(0, len(raw), SLICE):
        own = raw[i:i + SLICE]
        yield i, len(own), Words(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])]))


def strings(raw: list[bytes]) -> tuple:
    """Letter classes of all texts; first letter, size, row and a hash of the sentence of each word; first words and hashes of the runs of each length."""
    text, first, size, row, sentence = ([] for _ in range(5))
    starts, hashes = ([[] for _ in range(RUN)] for _ in range(2))
    letters = n_words = 0
    for i, _, words in sliced(raw):
        if not len(words.first):
            continue
        text.append(words.cls.astype(np.uint8))
        spans = Spans(text[-1])
        for m, k in enumerate(runs(words)):
            starts[m].append((k + n_words).astype(np.int32))
            hashes[m].append(spans(words.first[k], words.first[k + m] + words.size[k + m]))
        part = np.flatnonzero(np.concatenate([[True], (words.row[1:] != words.row[:-1]) | (words.sentence[1:] != words.sentence[:-1])]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes[0][-1] * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
        sentence.append(np.repeat(sums[np.append(part[1:], len(words.first))] - sums[part], np.diff(np.append(part, len(words.first)))))
        first.append(words.first + letters)
        size.append(words.size)
        row.append((words.row + i).astype(np.int32))
        letters, n_words = letters + len(words.cls), n_words + len(words.first)
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (text, first, size, row, sentence)]
    return *whole, *([np.concatenate(x) if x else np.zeros(0, np.int64) for x in kind] for kind in (starts, hashes))


class Names:
    """Strings by their number, cut from the letters when asked for."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.text, self.starts, self.stops = text, starts, stops

    def __getitem__(self, k: int) -> bytes:
        return self.text[self.starts[k]:self.stops[k]].tobytes()


class Model:
    """Weights per three letters, bias, and the logistic function of a document's worst words and runs."""

    def __init__(self, texts: list[str], labels: np.ndarray, base: float):
        self.base, self.machines, self.logistic = base, [None, None], None
        if len(set(labels.tolist())) < 2:
            return
        raw = [t.encode() for t in texts]
        apart = np.zeros(len(raw), bool)
        for kind in (0, 1):
            own = np.flatnonzero(labels == kind)
            if (labels == 1).sum() >= ENOUGH:
                apart[own[APART - 1::APART]] = True
        # Distinct strings by their letters; how many documents of each kind hold each.
        text, first, size, row, sentence, starts, hashes = strings(raw)
        if not len(first):
            return
        place = np.concatenate(starts)
        of = np.repeat(np.arange(RUN, dtype=np.int32), [len(x) for x in starts])
        _, at, ids = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        ids = ids.astype(np.int32)
        del hashes
        start, stop = first[place[at]], first[place[at] + of[at]] + size[place[at] + of[at]]
        n_names, size, n_words = len(at), stop - start, len(first)
        names = Names(text, start, stop)
        cuts = np.cumsum([0, *(len(x) for x in starts)])
        word_ids, row = ids[:n_words], row[place]
        learn = np.flatnonzero(~apart[row])
        pairs = np.unique(row[learn].astype(np.int64) * n_names + ids[learn])
        toxic = labels[pairs // n_names] == 1
        # Copies of a sentence are one witness: a string has as many as it has toxic documents, or distinct sentences in them if fewer.
        sentence = np.unique(sentence, return_inverse=True)[1][place]
        bad = learn[labels[row[learn]] == 1]
        witnesses = np.bincount(np.unique(sentence[bad] * n_names + ids[bad]) % n_names, minlength=n_names)
        n_toxic = np.minimum(np.bincount(pairs[toxic] % n_names, minlength=n_names), witnesses)
        n_clean = np.bincount(pairs[~toxic] % n_names, minlength=n_names)
        all_toxic, all_clean = int((labels[~apart] == 1).sum()), int((labels[~apart] == 0).sum())
        odds = np.log((n_toxic + 0.5) / (all_toxic + 1)) - np.log((n_clean + 0.5) / (all_clean + 1))
        rate = all_toxic / (all_toxic + all_clean)
        both = np.maximum(n_toxic + n_clean, 1)
        surprise = 2 * (n_toxic * np.log(np.maximum(n_toxic, 1e-9) / (both * rate)) + n_clean * np.log(np.maximum(n_clean, 1e-9) / (both * (1 - rate))))
        passes = (size > 2) & (surprise > SURPRISE) & (odds > 1.5)
        if not passes.any():  # too few labels for any string to pass: those that come nearest
            near = np.flatnonzero((size > 2) & (n_toxic > 0) & (odds > 0))
            passes[near[np.argsort(-surprise[near], kind="stable")[:LANDMARKS]]] = True
        found = np.zeros(n_names, bool)
        told = np.zeros(n_words + RUN, bool)  # words from which on a shorter run speaks
        for m, begin in enumerate(starts):
            own = ids[cuts[m]:cuts[m + 1]]
            implied = np.zeros(n_names, bool)
            if m:
                implied[own[told[begin] | told[begin + 1]]] = True
            found[own] |= (passes & ~implied)[own]
            now = np.zeros_like(told)
            now[begin] = found[own]
            if m:
                now[begin] |= told[begin] | told[begin + 1]
            told = now
        single = np.zeros(n_names, bool)
        single[word_ids] = True
        del place, of, ids, word_ids, own, begin, row, learn, pairs, toxic, sentence, bad, first, starts  # as large as the sample
        for k, kind in enumerate((single, ~single)):
            speaks, clean = np.flatnonzero(found & kind), np.flatnonzero((size > 2) & (n_clean > 0) & (odds < 0.5) & kind & ~found)
            if not len(speaks) or not len(clean):
                continue
            speaks = speaks[np.argsort(-(n_toxic * odds)[speaks], kind="stable")]
            often = clean[np.argsort(-n_clean[clean], kind="stable")]
            spread = np.sort(clean[np.argsort((clean * 2654435761) % (1 << 32), kind="stable")][:NEGATIVES - min(len(clean), NEGATIVES // 3)])
            negative = np.unique(np.concatenate([often[:NEGATIVES // 3], spread]))
            marks = np.concatenate([speaks[:LANDMARKS * 3 // 4], often[:LANDMARKS - min(len(speaks), LANDMARKS * 3 // 4)]])
            table = self.explicit([names[j] for j in marks])
            whole = table @ table.T
            values, vectors = np.linalg.eigh(whole)
            good = values > 1e-6 * values[-1]
            white = vectors[:, good] / np.sqrt(values[good])
            x = self.kernel([names[j] for j in np.concatenate([speaks, negative])], table) @ white
            y = np.concatenate([np.ones(len(speaks)), -np.ones(len(negative))])
            weight = np.concatenate([np.maximum(1, n_toxic[speaks]) / n_toxic[speaks].sum(), np.full(len(negative), 1 / len(negative))])
            solved = self.machine(x, y, weight)
            self.machines[k] = ((white @ solved[:-1]) @ table, float(solved[-1]))
        if not any(self.machines):
            return
        seen = np.vstack([features([top(r, v, n) for r, v in worst(words, self.machines)], np.bincount(words.row, minlength=n)) for _, n, words in sliced(raw)])
        judged = apart if apart.any() else ~apart
        share = np.where(labels[judged] == 1, base / max(1, (labels[judged] == 1).sum()), (1 - base) / max(1, (labels[judged] == 0).sum()))
        self.logistic = self.regression(seen[judged], labels[judged], share * judged.sum())

    @staticmethod
    def joined(names: list[bytes]) -> Words:
        """Words of given letter classes."""
        out = object.__new__(Words)
        out.cls = np.frombuffer(b"".join(names), np.uint8).astype(np.int64)
        out.size = np.array([len(x) for x in names])
        out.first = np.cumsum(out.size) - out.size
        out.word = np.repeat(np.arange(len(names)), out.size)
        return out

    def explicit(self, names: list[bytes]) -> np.ndarray:
        """The normed weights of all three letters in each word: the kernel of two words is the product of their rows."""
        words, out = self.joined(names), np.zeros((len(names), CLASSES ** 3))
        for word, index, weight in subsequences(words):
            np.add.at(out, (word, index), weight)
        return out / norms(words.size)[:, None]

    def kernel(self, names: list[bytes], table: np.ndarray) -> np.ndarray:
        if len(names) > 5_000:
            return np.vstack([self.kernel(names[i:i + 5_000], table) for i in range(0, len(names), 5_000)])
        words = self.joined(names)
        found = list(subsequences(words))
        out = np.empty((len(names), len(table)))
        for k, row in enumerate(table):
            total = np.zeros(len(names))
            for word, index, weight in found:
                total += weight * np.bincount(word, weights=row[index], minlength=len(names))
            out[:, k] = total
        return out / norms(words.size)[:, None]

    @staticmethod
    def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weights and bias of least regular + weighted squared hinge loss."""
        x = np.hstack([x, np.ones((len(x), 1))])
        solved, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], REGULAR)
        penalty[-1] = 1e-9
        for _ in range(50):
            active = y * (x @ solved) < 1
            a = x[active] * weight[active, None]
            new = np.linalg.solve(a.T @ x[active] + np.diag(penalty), a.T @ y[active])
            if np.allclose(new, solved, atol=1e-9):
                break
            solved = 0.5 * (solved + new)
        return solved

    @staticmethod
    def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        solved = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ solved, -30, 30)))
            slope = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve(x.T @ (x * slope[:, None]) + 0.05 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 0.05 * solved)
            solved = solved + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        return solved

    def score(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        n = len(batch)
        if self.logistic is None:
            return np.full(n, self.base)
        found, count = [[(np.zeros(0, np.int64), np.zeros(0))] for _ in range(2)], np.zeros(n)
        for i, data, offsets in pieces(batch, column, space_table()):
            words = Words(data, offsets)
            count += np.bincount(words.row + i, minlength=n)
            for held, (row, value) in zip(found, worst(words, self.machines), strict=True):
                held.append((row + i, value))
        seen = features([top(*map(np.concatenate, zip(*held, strict=True)), n) for held in found], count)
        return 1 / (1 + np.exp(-np.clip(seen @ self.logistic, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model, built on the driver from a bounded sample of the rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    base = float(total["toxic"] or 0) / max(1, total["n"])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(TOXIC_DOCUMENTS).unionByName(known.where("toxic = 0").orderBy(*order).limit(CLEAN_DOCUMENTS))
    texts = documents.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).orderBy(*order).collect()
    return Model([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), base)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    made = sent(documents.sparkSession, fit(documents, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch, "text"))], ["doc_id", "score"])

    out = documents.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
