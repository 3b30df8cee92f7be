"""Language identification, words first, then ever shorter character n-grams.

Words are runs of letters, lower-cased (characters beyond ASCII count as letters but for general and Latin-1 punctuation).

Fitting: word and n-gram counts per language over a sample of labelled documents, about `TRAIN_DOCUMENTS` of each language (all, where it
has fewer), so that a rare language is learnt from however large the corpus is. The `VOCABULARY` most frequent words of each
language are the known ones, each with its add-one log frequency in every language; the `GRAMS` most frequent character n-grams of
each language and length, 4 to 1 letters, told apart at the start and the end of words, back them up. Words and n-grams are kept as
64-bit hashes, and their counts only for the languages that they occur in, so that the model grows with what the languages
have of their own. Every language is learnt; their names and the model go through the driver.

Scoring: a known word adds its log frequencies. An unseen word adds the mean log frequencies of its known n-grams of the
greatest length that has any; with none of any length it adds nothing. The language with the greatest sum is predicted (the first
in text order on a tie), and the score is its share after a softmax of the sums.

Rows: a null text and one without a letter is `und` with score 0. A text without any evidence gets the most frequent
language with score 1 / number of languages; with no labelled document at all, everything is `und`. doc_id (null too) is passed
through, repeated rows are predicted alike, other columns are not looked at. Very long texts are read piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from caretally.llm.blocks import Spans, pieces, row_of
from caretally.llm.store import sent, table

#: About so many documents of each language are learnt from, chosen by a hash of doc_id.
TRAIN_DOCUMENTS = 5_000
#: Known words, and n-grams of each length, that a language brings in at most.
VOCABULARY, GRAMS = 15_000, 7_500
#: Cells of the table of unseen words and languages that are held at a time.
CELLS = 4_000_000
LONGEST = 4
UND = "und"
#: The softmax treats a text as if it had at most so many words, so that scores stay comparable.
SCORE_WORDS = 50
#: The pipeline rejects a document below this score.
MIN_SCORE = 0.3
SEPARATOR = ~np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lowered(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(batch.schema.get_field_index(column)))], [column])


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased texts."""
    letter = ~SEPARATOR[data]
    for lead, second, length in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == lead)
        if second is not None and len(at):
            at = at[np.isin(data[np.minimum(at + 1, len(data) - 1)], second)]
        for k in range(length):
            letter[at[at + k < len(data)] + k] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    return np.flatnonzero(letter & (~before | cut[:-1])), np.flatnonzero(letter & (~after | cut[1:])) + 1


def grams(data: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of the words, and which word each belongs to."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[owner]
    chars = (data[place] & 0xC0) != 0x80
    owner, place = owner[chars], place[chars]
    stop = np.append(place, 0)
    m = len(place) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:m] == owner[n - 1:])
    own, begin = owner[first], place[first]
    whole = np.append(owner, -1)[first + n] != own
    end = np.where(whole, ends[own], stop[first + n])
    edge = (begin == starts[own]).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + whole.astype(np.uint64) * np.uint64(0xE220A8397B1DCDAF)
    return spans(begin, end) + edge, own


def counts_by_language(documents: DataFrame, sample: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(lang, length, key, n) over the sample; length 0 stands for words, others for n-grams. The most frequent keys only."""
    usable = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    large = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().where(F.col("count") > sample).collect()}  # languages, not rows
    share = F.create_map(*[F.lit(x) for lang, n in large.items() for x in (lang, int((1 << 30) * sample / n))]) if large else None
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1 << 30)) if large else F.lit(True)
    chosen = usable.where(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for i, data, offsets in pieces(lowered(batch, "text"), "text", SEPARATOR):
                starts, ends = letter_runs(data, offsets)
                spans = Spans(data)
                lang = codes[i + row_of(offsets, starts)]
                for code in np.unique(lang):
                    own = np.flatnonzero(lang == code)
                    keys, at, n = np.unique(spans(starts[own], ends[own]), return_index=True, return_counts=True)
                    parts = [(0, keys, n)]
                    for size in range(1, LONGEST + 1):
                        g, owner = grams(data, spans, starts[own[at]], ends[own[at]], size)
                        k, back = np.unique(g, return_inverse=True)
                        parts.append((size, k, np.bincount(back, weights=n[owner], minlength=len(k)).astype(np.int64)))
                    for size, k, n in parts:
                        yield pa.RecordBatch.from_arrays([pa.array([str(names[code])] * len(k), pa.string()), pa.array(np.full(len(k), size, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))],
                                                         ["lang", "length", "key", "n"])

    counted = table(chosen.select("lang", "text").mapInArrow(count, "lang string, length int, key long, n long").groupBy("lang", "length", "key").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang", "length").orderBy(F.desc("n"), "key"))  # one language's share of a bounded sample
    known = counted.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("length") > 0, GRAMS).otherwise(VOCABULARY)).select("length", "key").distinct()
    return counted.join(known, ["length", "key"])


class Level:
    """Known keys of one length in ascending order; which languages each occurs in, and the log of its count plus one there; and the
    log of each language's total, in which every known key counts once more than seen."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int):
        order = np.lexsort((lang, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.lang, self.gain = lang[order], np.log(n[order] + 1.0)
        self.total = np.log(np.bincount(lang, weights=n, minlength=languages) + max(1, len(self.keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def sums(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Sum of the log frequencies of known keys by row and language."""
        width = len(self.total)
        size = self.first[at + 1] - self.first[at]
        cell = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.bincount(np.repeat(rows, size) * width + self.lang[cell], weights=self.gain[cell], minlength=n * width).reshape(n, width)
        return out - np.bincount(rows, minlength=n)[:, None] * self.total


class Model:
    """Languages, and the log frequencies of known words (level 0) and n-grams."""

    def __init__(self, counts: pa.Table):
        names, codes = np.unique(counts["lang"].to_numpy().astype(str), return_inverse=True) if len(counts) else (np.zeros(0, str), np.zeros(0, int))
        lengths, keys, n = (counts[c].to_numpy() for c in ("length", "key", "n"))
        self.languages = [str(x) for x in names]
        self.default = int(np.argmax(np.bincount(codes[lengths == 0], weights=n[lengths == 0], minlength=len(names)))) if len(names) else -1
        self.levels = [Level(keys[lengths == size].view(np.uint64), codes[lengths == size], n[lengths == size], len(names)) for size in range(LONGEST + 1)]

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies per text and language, and the number of words with evidence."""
        n, width = len(offsets) - 1, len(self.languages)
        starts, ends = letter_runs(data, offsets)
        rows, spans = row_of(offsets, starts), Spans(data)
        keys = spans(starts, ends)
        at = self.levels[0].find(keys)
        out = self.levels[0].sums(rows[at >= 0], at[at >= 0], n)
        used = np.bincount(rows[at >= 0], minlength=n)
        left = np.flatnonzero(at < 0)
        _, first, back = np.unique(keys[left], return_index=True, return_inverse=True)
        order = np.argsort(back, kind="stable")
        cuts = np.searchsorted(back[order], np.arange(len(first) + 1))
        step = max(1, CELLS // width)
        for a in range(0, len(first), step):
            unseen = left[first[a:a + step]]
            values, done = self.backed_off(data, spans, starts[unseen], ends[unseen])
            own = order[cuts[a]:cuts[min(a + step, len(first))]]
            own = own[done[back[own] - a]]
            text, word = rows[left[own]], back[own] - a
            for k in range(0, len(own), step):
                np.add.at(out, text[k:k + step], values[word[k:k + step]])
            used += np.bincount(text, minlength=n)
        return out, used

    def backed_off(self, data: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unseen words the mean log frequencies of their known n-grams of the greatest length that has any; and whether one has."""
        values, done = np.zeros((len(starts), len(self.languages))), np.zeros(len(starts), bool)
        for size in range(LONGEST, 0, -1):
            open_ = np.flatnonzero(~done)
            g, owner = grams(data, spans, starts[open_], ends[open_], size)
            hit = self.levels[size].find(g)
            owner, hit = owner[hit >= 0], hit[hit >= 0]
            number = np.bincount(owner, minlength=len(open_))
            some = number > 0
            values[open_[some]] = (self.levels[size].sums(owner, hit, len(open_)) / np.maximum(number, 1)[:, None])[some]
            done[open_[some]] = True
        return values, done

    def predict(self, batch: pa.RecordBatch, column: str) -> tuple[list[str], np.ndarray]:
        texts = lowered(batch, column)
        n, width = len(batch), len(self.languages)
        sums, used = np.zeros((n, width)), np.zeros(n, np.int64)
        plain = np.zeros(n, bool)
        for i, data, offsets in pieces(texts, column, SEPARATOR):
            j = i + len(offsets) - 1
            ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
            plain[i:j] |= np.diff(ascii_letters[offsets]) > 0
            if width:
                s, u = self.sums(data, offsets)
                sums[i:j] += s
                used[i:j] += u
        lettered = plain
        for k in np.flatnonzero(~plain):
            text = texts.column(0)[int(k)].as_py()
            lettered[k] = bool(text) and any(map(str.isalpha, text))
        if not width:
            return [UND] * n, np.zeros(n)
        best = np.argmax(sums, 1)
        best[used == 0] = self.default
        share = np.exp((sums - sums[np.arange(n), best][:, None]) * np.minimum(1.0, SCORE_WORDS / np.maximum(used, 1))[:, None])
        score = np.where(lettered, 1.0 / share.sum(1), 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], score


def fit(documents: DataFrame, sample: int = TRAIN_DOCUMENTS) -> Model:
    """The model, built on the driver from at most VOCABULARY + LONGEST * GRAMS keys of each language."""
    return Model(counts_by_language(documents, sample).toArrow())


def predict(documents: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns with the predicted language and its score, under names that the input must not have."""
    if {lang.lower(), score.lower()} & {c.lower() for c in documents.columns}:
        raise ValueError(f"the input has a column {lang} or {score}")
    made, names = sent(documents.sparkSession, model), [*documents.columns, lang, score]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made()
        for batch in batches:
            langs, scores = model.predict(batch, "text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names)

    return documents.mapInArrow(work, T.StructType([*documents.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def free_name(documents: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new."""
    while name.lower() in {c.lower() for c in documents.columns}:
        name = "_" + name
    return name


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the rows that are not held out."""
    out = predict(documents.select("doc_id", "text"), fit(documents))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is recognised, with their columns: those without letters and those with a low score go."""
    lang, score = free_name(documents, "lang_pred"), free_name(documents, "score")
    found = predict(documents, fit(documents), lang, score)
    return found.where((F.col(lang) != UND) & (F.col(score) >= min_score)).select(*documents.columns)
