"""Whole texts to token ids with a public tokenizer, each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from rankloom.llm.hashing import flat_bytes, sized, word_hashes, word_spans

CHUNK_BYTES = 2_000_000
POOL_WORDS = 1_500_000
LATE_WORDS = 100_000
LONGEST_KEPT = 64

# The steps of a tokenizer for which words can be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in '.,;:!?()"']] = True

_CODECS: dict[str, WordCodec] = {}


def gathered(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start .. start + len - 1 of each span in turn."""
    after = np.cumsum(lens)
    return np.repeat(starts - after + lens, lens) + np.arange(int(after[-1]) if len(after) else 0)


class Pool:
    """Ids and bytes of words by the words' 64-bit hashes: a large sorted table and a small one of late words."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.levels = [(none.astype(np.uint64), *[none] * 4) for _ in range(2)]
        self.ids, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of start and length of the ids, start and length of the bytes of each key; -1 for unknown keys."""
        out = np.full((4, len(keys)), -1, np.int64)
        for have, *about in self.levels:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = np.flatnonzero(have[at] == keys)
                out[:, hit] = [a[at[hit]] for a in about]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, lens: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> None:
        fresh = (keys, len(self.ids) + np.cumsum(lens) - lens, lens, len(self.letters) + np.cumsum(sizes) - sizes, sizes)
        self.ids, self.letters = np.concatenate([self.ids, ids]), np.concatenate([self.letters, letters])
        self.levels[1] = merged(self.levels[1], fresh)
        if len(self.levels[1][0]) > LATE_WORDS:
            self.levels = [merged(*self.levels), tuple(x[:0] for x in fresh)]


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    order = np.argsort(np.concatenate([a[0], b[0]]))
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


class WordCodec:
    """Ids of texts by a tokenizer, each distinct word encoded once.

    Words are cut at ASCII white space, and an ASCII letter from a punctuation mark after it. With the normaliser and
    pre-tokenizer named above every such cut is one for the tokenizer too: it drops white space, and no normalisation
    joins such a letter to such a mark (other letters may end in a combining mark once lower-cased or decomposed, so
    they are not cut off). A tokenizer of other steps, or with added tokens that hold white space or such a pair, gets
    whole texts. A worker keeps the ids of a word by its hash, and its bytes, which are compared before the ids are
    used; texts of a batch in which any two words share a hash are encoded whole. The pool is emptied at POOL_WORDS
    words (some 60 bytes each) and keeps none of more than LONGEST_KEPT bytes, which bounds memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_are_safe(json.loads(self.tokenizer.to_str()))
        self.pool = Pool()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts in them; a null text has none."""
        found = self.words_encoded(texts) if self.by_words else None
        if found is not None:
            return found
        ids, lens = self.whole([t or "" for t in texts.to_pylist()])
        return ids, np.concatenate([[0], np.cumsum(lens)])

    def words_encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        data, starts, ends = flat_bytes(texts)
        ws, we, bounds = word_spans(data, starts, ends)
        cut = np.flatnonzero(LETTER[data[:-1]] & MARK[data[1:]]) + 1
        ws, we = np.sort(np.concatenate([ws, cut])), np.sort(np.concatenate([we, cut]))
        bounds = np.concatenate([np.searchsorted(ws, starts), [len(ws)]])
        keys, first, at = np.unique(word_hashes(data, ws, we), return_index=True, return_inverse=True)
        sizes = we - ws
        if not same_bytes(data, ws, sizes, data, ws[first][at], sizes[first][at]):
            return None
        if len(self.pool) + len(keys) > POOL_WORDS:
            self.pool = Pool()
        start, length, letters, size = self.pool.find(keys)
        old, new = np.flatnonzero(start >= 0), np.flatnonzero(start < 0)
        if not same_bytes(data, ws[first[old]], sizes[first[old]], self.pool.letters, letters[old], size[old]):
            return None
        ids = self.pool.ids
        if len(new):
            raw = data.tobytes()
            fresh, lens = self.whole([raw[a:b].decode() for a, b in zip(ws[first[new]].tolist(), we[first[new]].tolist(), strict=True)])
            start[new], length[new] = len(ids) + np.cumsum(lens) - lens, lens
            ids = np.concatenate([ids, fresh])
            short = sizes[first[new]] <= LONGEST_KEPT
            kept = first[new][short]
            self.pool.add(keys[new][short], fresh[np.repeat(short, lens)], lens[short], data[gathered(ws[kept], sizes[kept])], sizes[kept])
        start, length = start[at], length[at]
        return ids[gathered(start, length)], np.concatenate([[0], np.cumsum(length)])[bounds]


def same_bytes(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether each span of a equals its span of b."""
    return np.array_equal(a_size, b_size) and np.array_equal(a[gathered(a_at, a_size)], b[gathered(b_at, b_size)])


def cuts_are_safe(config: dict) -> bool:
    """Whether the tokenizer's steps are those for which its ids are the words' ids in turn."""
    normalizer, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    plain = normalizer.get("normalizers") == NORMALIZERS and len(steps) == 2 and steps[0] == SPLIT
    plain = plain and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    added = [t["content"] for t in config.get("added_tokens", [])]
    return plain and not any(re.search(r"\s|[A-Za-z][.,;:!?()\"]", t) for t in added) and not any(t["single_word"] for t in config["added_tokens"])


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) in a size that suits `encode`."""
    return sized(batches, 1, CHUNK_BYTES)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    n = len(offsets) - 1
    out = np.insert(ids, offsets[1:], np.uint32(end))
    return out, offsets + np.arange(n + 1)
