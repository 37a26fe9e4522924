"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

The tokenizer's normaliser and pre-tokenizer work inside runs without white
space, so a text's ids are those of its ASCII-separated words one after
another.  A batch's words are hashed together and compared by their bytes; a
word that this worker has not met goes through the library, all others are
gathered from its memory.  A hash only says where to look: words of one hash
are told apart by their bytes.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tarn.llm import _text

#: Words that a worker remembers; beyond it the memory starts anew.
MEMORY = 800_000
#: One piece for as many of them has its ids kept by name.
WORDS_A_PIECE = 8

#: Letters whose lower case is one letter and which no normal form changes, then punctuation that no contraction begins with.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: The shape of a tokenizer for which that holds.
_SHAPE = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "pretokenizers": ["Split", "ByteLevel"],
}


def _visible_bytes() -> dict[int, str]:
    """The characters that stand for bytes in byte-level BPE: printable ones as they are, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


_VISIBLE = _visible_bytes()

_coders: dict[tuple[str, int], WordCoder] = {}


class WordCoder:
    """Encodes string columns to flat ids with offsets."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        shape = {
            "normalizers": [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])],
            "pattern": (split[0].get("pattern") or {}).get("Regex"),
            "pretokenizers": [x.get("type") for x in split],
        }
        self.model = self.tokenizer.model if shape == _SHAPE else None
        self._forget()

    def _piece(self, piece: str) -> list[int]:
        if (ids := self.pieces.get(piece)) is None:
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(piece.encode().decode("latin1").translate(_VISIBLE))]
        return ids

    def _library(self, spans: list[str]) -> list[list[int]]:
        """The ids of spans that this worker has not met."""
        found: list = [None] * len(spans)
        rest = []
        for i, span in enumerate(spans):
            if self.model is not None and (m := _PLAIN(span)):
                word, marks = m.groups()
                found[i] = self._piece(word.lower()) + (self._piece(marks) if marks else [])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([spans[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.odd: dict[bytes, int] = {}  # places of words whose hash another word has
        self.raw = np.zeros(1 << 16, np.uint8)  # the words' bytes
        self.raw_starts = np.zeros(1 << 14, np.int64)
        self.raw_lengths = np.zeros(1 << 14, np.int32)
        self.raw_used = self.count = 0
        self.at = np.zeros(0, np.int32)
        self.pieces: dict[str, list[int]] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int32)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Remembers new words; gives their places."""
        if len(self.pieces) > self.memory // WORDS_A_PIECE:
            self.pieces = {}
        found = self._library([w.decode() for w in words])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total, size, k = int(lengths.sum()), int(sizes.sum()), self.count
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.raw) < self.raw_used + size + 8:
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while len(self.starts) < k + len(keys):
            for name in ("starts", "lengths", "raw_starts", "raw_lengths"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.raw[self.raw_used : self.raw_used + size] = np.frombuffer(b"".join(words), np.uint8)
        new = slice(k, k + len(keys))
        self.starts[new] = self.used + np.cumsum(lengths) - lengths
        self.lengths[new] = lengths
        self.raw_starts[new] = self.raw_used + np.cumsum(sizes) - sizes
        self.raw_lengths[new] = sizes
        self.used += total
        self.raw_used += size
        self.count += len(keys)
        places = k + np.arange(len(keys), dtype=np.int32)
        # of words of one hash the first is found by it, the others by their bytes
        fresh = np.zeros(len(keys), bool)
        fresh[np.unique(keys, return_index=True)[1]] = True
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            fresh &= self.keys[near] != keys
        for i in np.flatnonzero(~fresh).tolist():
            self.odd[words[i]] = int(places[i])
        order = np.flatnonzero(fresh)[np.argsort(keys[fresh])]
        where = np.searchsorted(self.keys, keys[order])
        self.keys, self.at = np.insert(self.keys, where, keys[order]), np.insert(self.at, where, places[order])
        return places

    def _known(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of words, -1 of those that this worker has not met."""
        places = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return places
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[near] == keys)
        at = self.at[near[hit]].astype(np.int64)
        length = ends[hit] - starts[hit]
        same = length == self.raw_lengths[at]
        check = np.flatnonzero(same)
        same[check] = _text.same_spans(buf, starts[hit[check]], self.raw, self.raw_starts[at[check]], length[check], padded=True)
        places[hit[same]] = at[same]
        for i in hit[~same].tolist():
            places[i] = self.odd.get(buf[starts[i] : ends[i]].tobytes(), -1)
        return places

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and n + 1 offsets; ``end`` is appended to each text."""
        buf, off = _text.as_bytes(column)
        ws, we, word_off = _text.words(buf, off)
        h = _text.hash_spans(buf, ws, we)
        codes, first = _text.distinct_spans(buf, ws, we, h)
        keys, starts, ends = h[first], ws[first], we[first]
        places = self._known(keys, buf, starts, ends)
        new = np.flatnonzero(places < 0)
        if len(new):
            if self.count + len(new) > self.memory:
                self._forget()
                new = np.arange(len(first))
            raw = buf.tobytes()
            places[new] = self._learn(keys[new], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        at = places[codes]
        lengths = self.lengths[at].astype(np.int64)
        ids = self.flat[_text.ragged(self.starts[at].astype(np.int64), lengths)]
        per = np.concatenate([[0], np.cumsum(lengths)])[word_off]
        if end is None:
            return ids, per
        return np.insert(ids, per[1:], end), per + np.arange(len(per))


def _forget_coders() -> None:
    _coders.clear()


def coder(path: str, memory: int = MEMORY) -> WordCoder:
    """This worker's coder for a tokenizer file, which remembers so many words."""
    _text.remembers(_forget_coders)
    if (path, memory) not in _coders:
        _coders[path, memory] = WordCoder(path, memory)
    return _coders[path, memory]


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
