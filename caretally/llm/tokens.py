"""Token ids of whole texts by a public tokenizer, for the operators that write or pack ids.

Byte-level BPE never merges across the borders of its pre-tokens. A blank between two other characters always begins one, and so
does a change between letters and punctuation. So texts are cut there, each distinct chunk is given to the tokenizer once,
and the ids are put together again; they equal those of the whole text.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from caretally.llm.blocks import BLOCK, span_keys, text_blocks

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Chunks whose ids a task remembers before it starts anew.
REMEMBERED = 2_000_000
#: Bytes that may begin, and that may stand in, white space beyond ASCII.
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"))
LATIN_LETTER = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
#: In the alphabet of byte-level BPE printable Latin-1 characters stand for themselves, and characters from
#: 256 on for the other bytes in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = np.arange(256, dtype="<u4")
ALPHABET[~np.isin(np.arange(256), PRINTABLE)] = 256 + np.arange(256 - len(PRINTABLE))
BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the texts' starts, at single blanks, behind single line breaks, and between letters and
    punctuation (but for apostrophes, which begin contractions, and bars, which stand in special tokens)."""
    cut = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~BLANK[data[at - 1]] & ~BLANK[data[at + 1]] & ~LEADS[data[at + 1]] & (data[np.maximum(at - 2, 0)] != 0xC2) & ~LEADS[data[np.maximum(at - 3, 0)]]]
    cut[at + (data[at] == 10)] = True
    letter, mark = ASCII_LETTER[data], MARK[data]
    cut[1:-1] |= letter[:-1] & mark[1:]
    cut[1:-1] |= mark[:-1] & letter[1:]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which chunks are one pre-token of letters (ASCII and Latin-1), perhaps behind a blank."""
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & LATIN_LETTER[data[1:]]
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & second[1:]
    total = np.concatenate([[0], np.cumsum(ASCII_LETTER[data] | second | lead, dtype=np.int64)])
    begin = starts + (data[starts] == 32)
    return (ends > begin) & (total[ends] - total[begin] == ends - begin)


class Encoder:
    """Encodes blocks of texts, with a memory of chunks: a table by hash, in which a new chunk may oust another. A chunk is
    taken for a remembered one if a second, independent hash is equal too."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.model, self.mask = self.tokenizer.model, np.uint64((1 << (2 * remembered - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        self.ids, self.ends, self.checks = [np.zeros(0, np.uint32)], np.zeros(1, np.int64), np.zeros(1, np.uint64)

    def learn(self, data: np.ndarray, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """One pre-token of letters goes straight to the tokenizer's model, in the byte alphabet that its pre-tokenizer makes;
        other chunks go through the whole tokenizer."""
        raw, wide, model, whole = data.tobytes(), ALPHABET[data].tobytes(), self.model.tokenize, self.tokenizer.encode
        plain = plain_words(data, starts, ends).tolist()
        found = [[t.id for t in model(wide[4 * a:4 * b].decode("utf-32-le"))] if p else whole(raw[a:b].decode(errors="replace"), add_special_tokens=False).ids
                 for a, b, p in zip(starts.tolist(), ends.tolist(), plain, strict=True)]
        n = len(self.ends) - 1
        slot = keys & self.mask
        self.keys[slot], self.place[slot] = keys, np.arange(n, n + len(keys))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = [np.concatenate([*self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])]
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.checks = np.concatenate([self.checks[:n], checks, np.zeros(1, np.uint64)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and offsets per text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.ends) > self.remembered:
            self.clear()
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, checks = span_keys(data, starts, ends)
        keys |= np.uint64(1)
        slot = keys & self.mask
        found = self.place[slot].astype(np.int64)
        new = np.flatnonzero((self.keys[slot] != keys) | (self.checks[found] != checks))
        if len(new):
            known = len(self.ends) - 1
            order = new[np.lexsort((checks[new], keys[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
            at = order[other]
            self.learn(data, keys[at], checks[at], starts[at], ends[at])
            found[order] = known + np.cumsum(other) - 1
        first = self.ends[found]
        size = self.ends[found + 1] - first
        ends_of = np.cumsum(size)
        take = np.repeat(first - (ends_of - size), size)
        take += np.arange(len(take))
        counts = np.concatenate([[0], ends_of])[np.searchsorted(starts, offsets)]
        return self.ids[0][take], counts


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which later tasks find with its memory."""
    shared = sys.modules.setdefault("caretally_llm_worker", types.ModuleType("caretally_llm_worker"))
    if path not in shared.__dict__:
        shared.__dict__[path] = Encoder(path)
    return shared.__dict__[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int = END) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, row after the last, ids, offsets) of blocks of texts, each text with the end id behind it."""
    encoder = worker_encoder(path)
    for batch in batches:
        for i, j, data, offsets in text_blocks(batch, "text", BLOCK):
            ids, cuts = encoder(data, offsets)
            whole = np.full(len(ids) + j - i, end, np.uint32)
            cuts_end = cuts + np.arange(len(cuts))
            own = np.ones(len(whole), bool)
            own[cuts_end[1:] - 1] = False
            whole[own] = ids
            yield batch, i, j, whole, cuts_end
