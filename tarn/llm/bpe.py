"""Byte-level BPE by recursive queries of DuckDB, one small database per worker.

Texts are split where the pattern's matches must part (before each run of white
space), equal stretches of a batch once, and stretches into the pattern's
matches.  Matches that this worker has not met become rows (word, position,
token); a recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of least rank until no word has a pair
left.  Words leave the recursion as they reach that fixpoint.  Decoding is an
ordered aggregation of the tokens' bytes.

The recursion holds every step's rows, so words of more than ``LONG`` bytes are
contracted by repeated statements over a table that each step replaces.  A step
contracts all pairs that no other pair can reach before their turn, so their
number does not follow the word's length; what exceeds the memory limit goes to
the worker's temp folder.

A null text counts as empty and has no ids; repeated rows give equal rows; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarn.llm import _rows, _text

#: Stretches and words that a worker remembers; beyond it either memory starts anew.
MEMORY = 700_000
#: Bytes of unmet words that one recursive query takes (or one longer word).
ROUND = 1 << 19
#: Rows that the recursion may hold: a word of n bytes has up to n * n / 2.
ROWS = 4_000_000
#: Bytes of a word beyond which it is contracted outside the recursion.
LONG = 1024
#: Byte positions of a long word whose tokens are aggregated together.
STRETCH = 1 << 18


def _rare(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold white space that is not ASCII, or separators that only some call white space."""
    at = [np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))]
    pad = np.append(buf, [0, 0])
    for first, rest in _WIDE_SPACE.items():
        lead = np.flatnonzero(buf == first)
        for second, third in rest:
            hit = lead[pad[lead + 1] == second]
            at.append(hit if third is None else hit[np.isin(pad[hit + 2], third)])
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.concatenate(at), side="right") - 1] = True
    return out


#: The UTF-8 bytes of white space beyond ASCII: first -> (second, thirds).
_WIDE_SPACE = {
    0xC2: ((0x85, None), (0xA0, None)),
    0xE1: ((0x9A, [0x80]),),
    0xE2: ((0x80, [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0xA8, 0xA9, 0xAF]), (0x81, [0x9F])),
    0xE3: ((0x80, [0x80]),),
}

#: Stretches that are one match of the pattern, whatever stands before or after them: the pattern takes letters with the one space before them.
_ONE = re.compile(r" [a-z]+").fullmatch

#: Rows are (key, token, rank, nth): key is the word's number and the position, rank that of the token with the one after it, nth the step.
#: One ordering of the rows a step serves both the contraction and the pairs that it makes.
_ENCODE = """
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE step(key, token, rank, nth) AS (
    SELECT t.key, t.token, m.merged, 0 FROM (
        SELECT key, token, CASE WHEN lead(key) OVER w >> 32 = key >> 32 THEN lead(token) OVER w END AS follows
        FROM start WINDOW w AS (ORDER BY key)) t
    LEFT JOIN merges m ON m.l = t.token AND m.r = t.follows
  UNION ALL
    SELECT t.key, t.token, m.merged, t.nth + 1 FROM (
        SELECT key, nth, coalesce(merged, token) AS token,
               CASE WHEN merged IS NOT NULL THEN CASE WHEN lead(key, 2) OVER w >> 32 = key >> 32 THEN lead(token, 2) OVER w END
                    WHEN lead(key) OVER w >> 32 = key >> 32 THEN coalesce(lead(merged) OVER w, lead(token) OVER w) END AS follows,
               lag(merged) OVER w IS NULL AS stays
        FROM (SELECT s.key, s.token, s.nth, CASE WHEN s.key = b.at_key THEN s.rank END AS merged
              FROM step s JOIN (SELECT key >> 32 AS word, arg_min(key, CAST(rank AS BIGINT) * 4294967296 + (key & 4294967295)) AS at_key
                                FROM step WHERE rank IS NOT NULL GROUP BY word) b ON b.word = s.key >> 32)
        WINDOW w AS (ORDER BY key)) t
    LEFT JOIN merges m ON m.l = t.token AND m.r = t.follows
    WHERE t.stays
)
SELECT s.key >> 32 AS word, s.key, s.token FROM step s JOIN (SELECT key >> 32 AS word, max(nth) AS last FROM step GROUP BY word) l ON l.word = s.key >> 32 AND l.last = s.nth
"""

#: Ranks with the tokens to each side that can matter to them, and whether their token may merge at a lower rank (early).
#: Before a pair's turn only lower ranks merge: no token of such a rank spans ``reach`` tokens, nor do one from outside and one from the pair meet.
_REACH = """
CREATE TABLE reaches AS
SELECT b.token AS merged, CAST(2 * max(octet_length(unhex(b.hex))) OVER (ORDER BY b.token) + 4 AS INTEGER) AS reach,
       b.token IN (SELECT l FROM merges WHERE merged < l UNION ALL SELECT r FROM merges WHERE merged < r) AS early
FROM bytes b
"""
#: Rows are (key, token, rank), as above but with 2147483647 for no rank.
_NO_RANK = "2147483647"
_LONG_START = f"""
CREATE OR REPLACE TEMP TABLE live AS
SELECT t.key, t.token, coalesce(m.merged, {_NO_RANK}) AS rank FROM (
    SELECT key, token, CASE WHEN lead(key) OVER w >> 32 = key >> 32 THEN lead(token) OVER w END AS follows FROM start WINDOW w AS (ORDER BY key)) t
LEFT JOIN merges m ON m.l = t.token AND m.r = t.follows
"""
#: A pair of least rank in its reach is contracted, of equal ranks side by side every second one.  Equal early ranks with less than their reach
#: between them go from the left, up to the first whose token makes a pair of lower rank with what stands beside it then.
_LONG_STEP = f"""
CREATE OR REPLACE TEMP TABLE next AS
WITH near AS MATERIALIZED (
    SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT l.key, l.token, l.rank, coalesce(r.early, false) AS early, r.reach, row_number() OVER w AS nth, lag(l.rank) OVER w IS DISTINCT FROM l.rank AS opens,
                 lag(l.token) OVER w AS before, lead(l.token, 2) OVER w AS after,
                 min(l.rank) OVER (ORDER BY l.key ROWS BETWEEN coalesce(r.reach, 0) PRECEDING AND coalesce(r.reach, 0) FOLLOWING) AS least
          FROM live l LEFT JOIN reaches r ON r.merged = l.rank WINDOW w AS (ORDER BY l.key))),
runs AS (SELECT run, bool_and(rank = least) AS safe, min(nth) AS first FROM near WHERE rank < {_NO_RANK} GROUP BY run),
paired AS MATERIALIZED (SELECT n.*, coalesce(r.safe, false) AS safe, coalesce((n.nth - r.first) % 2 = 0, false) AS chosen FROM near n LEFT JOIN runs r ON r.run = n.run),
ties AS (
    SELECT t.key, t.rank, t.nth, t.least, t.chosen, t.chosen AND (coalesce(x.merged < t.rank, false) OR coalesce(y.merged < t.rank, false)) AS lowers,
           sum(CASE WHEN t.far THEN 1 ELSE 0 END) OVER (PARTITION BY t.rank ORDER BY t.nth ROWS UNBOUNDED PRECEDING) AS cluster
    FROM (SELECT *, coalesce(nth - lag(nth) OVER (PARTITION BY rank ORDER BY nth) > reach, true) AS far
          FROM (SELECT *, CASE WHEN lag(chosen, 2) OVER w AND lag(rank, 2) OVER w = rank THEN rank ELSE before END AS beside FROM paired WINDOW w AS (ORDER BY key))
          WHERE early AND rank IN (SELECT rank FROM near WHERE early AND rank = least)) t
    LEFT JOIN merges x ON x.l = t.rank AND x.r = t.after LEFT JOIN merges y ON y.l = t.beside AND y.r = t.rank),
free AS (
    SELECT key FROM (SELECT key, chosen, sum(CASE WHEN rank > least THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS blocked,
                            coalesce(sum(CASE WHEN lowers THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower
                     FROM ties WINDOW w AS (PARTITION BY rank, cluster ORDER BY nth))
    WHERE chosen AND blocked = 0 AND lower = 0),
taken AS MATERIALIZED (SELECT p.key, p.token, p.rank, CASE WHEN p.early THEN f.key IS NOT NULL ELSE p.safe AND p.chosen END AS taken FROM paired p LEFT JOIN free f ON f.key = p.key),
placed AS MATERIALIZED (
    SELECT key, CASE WHEN taken THEN rank ELSE token END AS token, CASE WHEN changed THEN NULL ELSE rank END AS rank,
           CASE WHEN changed AND lead(key) OVER w >> 32 = key >> 32 THEN CASE WHEN lead(taken) OVER w THEN lead(rank) OVER w ELSE lead(token) OVER w END END AS follows
    FROM (SELECT *, taken OR coalesce(lead(taken) OVER (ORDER BY key), false) AS changed
          FROM (SELECT *, NOT coalesce(lag(taken) OVER (ORDER BY key), false) AS stays FROM taken) WHERE stays)
    WINDOW w AS (ORDER BY key))
SELECT key, token, rank FROM placed WHERE rank IS NOT NULL
UNION ALL
SELECT p.key, p.token, coalesce(m.merged, {_NO_RANK}) FROM (SELECT * FROM placed WHERE rank IS NULL) p LEFT JOIN merges m ON m.l = p.token AND m.r = p.follows
"""
_LONG_PART = "SELECT count(*), string_agg(l.token, ',' ORDER BY l.key), string_agg(b.hex, '' ORDER BY l.key) FROM live l JOIN bytes b ON b.token = l.token WHERE l.key >= {a} AND l.key < {b}"

_DECODE = "SELECT string_agg(b.hex, '' ORDER BY t.key) FROM {rows} t JOIN bytes b ON b.token = t.token GROUP BY t.word ORDER BY t.word"
_IDS = "SELECT count(*), string_agg(token, ',' ORDER BY key) FROM done GROUP BY word ORDER BY word"


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes words with the ranks of a vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        vocabulary = ranks(path)
        self.byte = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        rows = [(vocabulary[t[:i]], vocabulary[t[i:]], k) for t, k in vocabulary.items() for i in range(1, len(t)) if t[:i] in vocabulary and t[i:] in vocabulary]
        table = pa.table({c: pa.array(v, pa.int32()) for c, v in zip("lrm", zip(*rows))}).rename_columns(["l", "r", "merged"])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"tarn-bpe-{uuid.uuid4().hex}")})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("byte_rows", pa.table({"token": pa.array(list(vocabulary.values()), pa.int32()), "hex": pa.array([t.hex() for t in vocabulary])}))
        self.db.execute("CREATE TABLE bytes AS SELECT * FROM byte_rows")
        self.db.execute(_REACH)
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self._forget()

    def _forget(self) -> None:
        self.stretches: dict[bytes, int] = {}
        self.counts = np.zeros(1 << 14, np.int64)
        self.ids = np.empty(1 << 14, object)
        self.plain = np.empty(1 << 14, object)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, str, bytes]]:
        """The number of ids, the ids in decimal joined by commas, and the decoded bytes of each word."""
        out: list = [None] * len(words)
        short, size, rows = [], 0, 0
        for i, w in enumerate(words):
            n = len(w)
            if n > LONG:
                out[i] = self._long(w)
                continue
            if short and (size + n > ROUND or rows + n * (n + 1) // 2 > ROWS):
                self._round(words, short, out)
                short, size, rows = [], 0, 0
            short.append(i)
            size += n
            rows += n * (n + 1) // 2
        if short:
            self._round(words, short, out)
        return out

    def _start(self, words: list[bytes]) -> None:
        """Registers the bytes' tokens of words as the rows to start from."""
        lengths = np.array([len(w) for w in words])
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        key = np.repeat(np.arange(len(words)) << 32, lengths) + _text.ragged(np.zeros(len(words), np.int64), lengths)
        self.db.register("start", pa.table({"key": key, "token": token}))

    def _round(self, words: list[bytes], places: list[int], out: list) -> None:
        """Encodes the words at some places by one recursive query."""
        self._start([words[i] for i in places])
        self.db.execute(_ENCODE)
        self.db.unregister("start")
        ids = self.db.execute(_IDS).fetchall()
        plain = self.db.execute(_DECODE.format(rows="done")).fetchall()
        for i, (n, x), (h,) in zip(places, ids, plain):
            out[i] = n, x, bytes.fromhex(h)

    def _long(self, word: bytes) -> tuple[int, str, bytes]:
        """Encodes one word by a statement for each step; only the present step's rows are held."""
        self._start([word])
        self.db.execute(_LONG_START)
        self.db.unregister("start")
        while self.db.execute(f"SELECT count(*) FROM live WHERE rank < {_NO_RANK}").fetchone()[0]:
            self.db.execute(_LONG_STEP)
            self.db.execute("DROP TABLE live")
            self.db.execute("ALTER TABLE next RENAME TO live")
        parts = [self.db.execute(_LONG_PART.format(a=a, b=a + STRETCH)).fetchone() for a in range(0, len(word), STRETCH)]
        self.db.execute("DROP TABLE live")
        return sum(n for n, _, _ in parts), ",".join(x for _, x, _ in parts if x), b"".join(bytes.fromhex(h) for _, _, h in parts if h)

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of lists of ids, by ordered aggregation."""
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum()))
        self.db.register("given", pa.table({"word": np.repeat(np.arange(len(ids)), lengths), "key": np.arange(len(flat)), "token": flat}))
        found = iter(self.db.execute(_DECODE.format(rows="given")).fetchall())
        self.db.unregister("given")
        return [bytes.fromhex(next(found)[0]) if n else b"" for n in lengths.tolist()]

    def _learn(self, keys: list[bytes]) -> None:
        """Remembers the ids and decoded bytes of stretches of text."""
        texts = [k.decode() for k in keys]
        matches = [(t,) if _ONE(t) else self.pattern.findall(t) for t in texts]
        known = self.words
        new = list({w for m in matches for w in m if w not in known})
        if new:
            known.update(zip(new, self.encode_words([w.encode() for w in new])))
        at, n = len(self.stretches), len(keys)
        while len(self.ids) < at + n:
            self.counts, self.ids, self.plain = (np.concatenate([x, np.empty_like(x)]) for x in (self.counts, self.ids, self.plain))
        self.stretches.update(zip(keys, range(at, at + n)))
        counts, ids, plain = [], [], []
        for m in matches:
            if len(m) == 1:
                c, x, p = known[m[0]]
            else:
                found = [known[w] for w in m]
                c, x, p = sum(f[0] for f in found), ",".join([f[1] for f in found]), b"".join([f[2] for f in found])
            counts.append(c)
            ids.append(x)
            plain.append(p)
        self.counts[at : at + n], self.ids[at : at + n], self.plain[at : at + n] = counts, ids, plain

    def texts(self, column: pa.Array) -> list[tuple[int, list[str], list[bytes]]]:
        """For each text: the number of its ids, and the ids and decoded bytes of its stretches in order."""
        buf, off = _text.as_bytes(column)
        rare = _rare(buf, off)
        cs, ce, chunk_off = _text.chunks(buf, off)
        if rare.any():  # each such text is one stretch
            keep = np.ones(len(cs), bool)
            for i in np.flatnonzero(rare):
                keep[chunk_off[i] + 1 : chunk_off[i + 1]] = False
                ce[chunk_off[i]] = off[i + 1]
            cs, ce = cs[keep], ce[keep]
            chunk_off = np.searchsorted(cs, off)
        codes, first = _text.distinct_spans(buf, cs, ce)
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(cs[first].tolist(), ce[first].tolist())]
        if len(self.stretches) + len(keys) > MEMORY:
            self._forget()
        if len(self.words) > MEMORY:
            self.words = {}
        new = [k for k in keys if k not in self.stretches]
        if new:
            self._learn(new)
        places = np.array([self.stretches[k] for k in keys], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        counts = np.concatenate([[0], np.cumsum(self.counts[places])])[chunk_off]
        ids, plain, ends = self.ids[places].tolist(), self.plain[places].tolist(), chunk_off.tolist()
        return [(n, ids[a:b], plain[a:b]) for n, a, b in zip(np.diff(counts).tolist(), ends, ends[1:])]


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder for a rank file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        gc.disable()  # a worker's memory holds a million tuples and no cycles
        for batch in batches:
            text = batch.column("text")
            for a, b in _text.pieces(text, 2 << 20):
                found = own.texts(text.slice(a, b - a))
                joined = [",".join(filter(None, ids)) for _, ids, _ in found]
                plain = [b"".join(raw) for _, _, raw in found]
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": pa.array([n for n, _, _ in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([list(map(int, x.split(","))) if x else [] for x in joined], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(plain, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {_rows.id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return _rows.texts(docs).mapInArrow(rows, schema)
