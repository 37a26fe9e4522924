"""Token ids as Simple-8b words in shared files.

A 64-bit word holds a selector in its top four bits and 1 to 60 equally wide
values below.  Values of over 60 bits follow an escape word as they are.  Ids
are coded in blocks of ``BLOCK``; each block's first word has its offset in the
file's footer, so all blocks of a stretch are decoded at once, by selector.

A file: ``MAGIC``, the words of all blocks, then the footer (counts of the
documents' ids, their doc_ids with a validity byte, block offsets in words) and
its length.  Every partition of a range partitioning by doc_id is one file; a
task that runs again writes a new file, and only the manifest, which Spark
commits, says which files count.

Documents ascend by doc_id (null first); equal doc_ids are ordered by text.  A
null text counts as empty and has the end id alone; a doc_id that is no integer is an
error.  An empty table writes no file and reads back empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _rows, _store, _text, _tokens

MAGIC = b"TARNS8B1"
BLOCK = 1024
#: Words that a worker remembers: the texts that one takes here have more than the coder's default, and words met anew cost most.
MEMORY = 2_000_000
#: Fixed values of the coding: selector -> (bits of a value, values in a word); selector 0 is the escape.
WIDTHS = {2: (1, 60), 3: (2, 30), 4: (3, 20), 5: (4, 15), 6: (5, 12), 7: (6, 10), 8: (7, 8), 9: (8, 7), 10: (10, 6), 11: (12, 5), 12: (15, 4), 13: (20, 3), 14: (30, 2), 15: (60, 1)}
ESCAPE = 0
U64 = np.uint64
_LOW = U64((1 << 60) - 1)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs (at least 1)."""
    if not len(values) or int(values.max()) < 1 << 24:
        return np.maximum(np.frexp(values.astype(np.float32))[1], 1).astype(np.uint8)
    v, out = values.astype(np.uint64), np.ones(len(values), np.uint8)
    for b in (32, 16, 8, 4, 2, 1):
        big = v >= (U64(1) << U64(b))
        out[big] += b
        v = np.where(big, v >> U64(b), v)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and for each block its first word's place (n_blocks + 1 of them)."""
    n = len(values)
    n_blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    bits = _bits(values)
    most = int(bits.max())
    room = block - np.arange(n, dtype=np.int32) % block
    room[(n_blocks - 1) * block :] = n - np.arange((n_blocks - 1) * block, n)
    # the densest selector that each place could begin: wider ones are overwritten by denser ones
    choice = np.zeros(n, np.uint8)
    step = np.ones(n, np.int32)
    for s in sorted(WIDTHS, reverse=True):
        width, count = WIDTHS[s]
        if most <= width:  # it fits everywhere
            choice[:] = s
            np.minimum(room, count, out=step)
            continue
        narrow = np.flatnonzero(bits <= width)
        if not len(narrow):
            break
        take = np.minimum(room[narrow], count)
        last = np.flatnonzero(np.append(np.diff(narrow) > 1, True))
        run_end = np.repeat(narrow[last] + 1, np.diff(last, prepend=-1))
        fits = run_end - narrow >= take
        at = narrow[fits]
        choice[at] = s
        step[at] = take[fits]
    # all blocks advance together, a word at a time
    at = np.arange(n_blocks) * block
    stop = np.minimum(at + block, n)
    starts, owners = [], []
    live = np.arange(n_blocks)
    while len(live):
        now = at[live]
        starts.append(now)
        owners.append(live)
        at[live] = now = now + step[now]
        live = live[now < stop[live]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    sel = choice[start]
    words_of = 1 + (sel == ESCAPE)
    word_at = np.cumsum(words_of) - words_of
    out = np.zeros(int(words_of.sum()), np.uint64)
    for s, (width, count) in WIDTHS.items():
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        first, taken = start[mine], step[start[mine]]
        packed = np.full(len(mine), U64(s) << U64(60))
        for j in range(count):
            has = j < taken
            if has.all():
                packed |= values[first + j].astype(np.uint64) << U64(width * j)
            else:
                packed[has] |= values[first[has] + j].astype(np.uint64) << U64(width * j)
        out[word_at[mine]] = packed
    escaped = np.flatnonzero(sel == ESCAPE)
    out[word_at[escaped] + 1] = values[start[escaped]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=words_of, minlength=n_blocks).astype(np.int64))])
    return out, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of consecutive blocks; offsets are relative to the first of them."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> U64(60)).astype(np.uint8)
    # a word after an escape is a value whatever its bits; escapes alternate in runs
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        escape = sel == ESCAPE
        k = 0
        for k in np.flatnonzero(escape).tolist():
            if not raw[k]:
                raw[k + 1] = True
    count = np.zeros(16, np.int64)
    for s, (_, c) in WIDTHS.items():
        count[s] = c
    count[ESCAPE] = 1
    per = np.where(raw, 0, count[sel])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.concatenate([[0], np.cumsum(per)])
    start = owner * block + before[:-1] - before[offsets[owner]]
    limit = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s, (width, c) in WIDTHS.items():
        mine = np.flatnonzero((sel == s) & ~raw)
        if not len(mine):
            continue
        idx = start[mine][:, None] + np.arange(c)
        vals = ((words[mine] & _LOW)[:, None] >> (U64(width) * np.arange(c, dtype=np.uint64))) & U64((1 << width) - 1)
        inside = idx < limit[mine][:, None]
        out[idx[inside]] = vals[inside]
    escapes = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[start[escapes]] = words[escapes + 1]
    return out


class Writer:
    """Writes one file; ids go to disk as blocks fill."""

    def __init__(self, path: str) -> None:
        where, at = _store.opened(path)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        self.file = where.open_output_stream(at, compression=None)
        self.file.write(MAGIC)
        self.rest = np.zeros(0, np.int32)
        self.offsets = [np.zeros(1, np.int64)]
        self.words = self.n_ids = 0
        self.counts: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []

    def _put(self, values: np.ndarray) -> None:
        words, offsets = encode(values)
        self.file.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets[1:] + self.words)
        self.words += len(words)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, off: np.ndarray) -> None:
        self.valid.append(np.asarray(doc_ids.is_valid()))
        self.doc_ids.append(np.asarray(doc_ids.fill_null(0)).astype("<i8"))
        self.counts.append(np.diff(off))
        self.n_ids += len(ids)
        values = np.concatenate([self.rest, ids])
        full = len(values) // BLOCK * BLOCK
        self._put(values[:full])
        self.rest = values[full:]

    def close(self) -> None:
        self._put(self.rest)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        offsets = np.concatenate(self.offsets)
        footer = b"".join([
            np.array([len(counts), self.n_ids, len(offsets)], "<u8").tobytes(), counts.astype("<u8").tobytes(),
            np.concatenate(self.doc_ids).tobytes() if self.doc_ids else b"", np.concatenate(self.valid).astype("u1").tobytes() if self.valid else b"",
            offsets.astype("<u8").tobytes(),
        ])
        self.file.write(footer + np.array([len(footer)], "<u8").tobytes() + MAGIC)
        self.file.close()


def read(path: str, stretch: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """doc_ids, validity and ids of a file's documents, a stretch of blocks at a time."""
    where, at = _store.opened(path)
    with where.open_input_file(at) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a Simple-8b file")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        footer = f.read_at(length, size - 16 - length)
        n_docs, n_ids, n_off = (int(x) for x in np.frombuffer(footer, "<u8", 3))
        counts = np.frombuffer(footer, "<u8", n_docs, 24).astype(np.int64)
        doc_ids = np.frombuffer(footer, "<i8", n_docs, 24 + 8 * n_docs)
        valid = np.frombuffer(footer, "u1", n_docs, 24 + 16 * n_docs).astype(bool)
        offsets = np.frombuffer(footer, "<u8", n_off, 24 + 17 * n_docs).astype(np.int64)
        ends = np.cumsum(counts)
        held, held_from, doc = np.zeros(0, np.uint64), 0, 0
        for b in range(0, max(1, n_off - 1), stretch):
            e = min(n_off - 1, b + stretch)
            n = min(n_ids, e * BLOCK) - b * BLOCK
            if n > 0:
                words = np.frombuffer(f.read_at(8 * int(offsets[e] - offsets[b]), 8 + 8 * int(offsets[b])), "<u8")
                held = np.concatenate([held, decode(words, offsets[b : e + 1] - offsets[b], n)])
            upto = int(np.searchsorted(ends, held_from + len(held), side="right"))
            if upto > doc:
                cut = np.concatenate([[held_from], ends[doc:upto]]) - held_from
                yield doc_ids[doc:upto], valid[doc:upto], [held[x:y] for x, y in zip(cut[:-1], cut[1:])]
                held, held_from, doc = held[cut[-1] :], int(ends[upto - 1]), upto


def write(docs: DataFrame, tokenizer: str, directory: str, end: int = 2) -> list[dict]:
    """Writes the ids of all documents in ascending doc_id order; gives the manifest, a row per file in that order."""
    spark = docs.sparkSession

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = _tokens.coder(tokenizer, MEMORY), None
        for batch in batches:
            text, ids_of = batch.column("text"), batch.column("doc_id")
            for a, b in _text.pieces(text):
                if writer is None:
                    first = batch.column("part")[0].as_py()
                    path = f"{directory}/ids-{first:06d}-{uuid.uuid4().hex}.s8b"
                    writer = Writer(path)
                writer.add(ids_of.slice(a, b - a), *coder.encode(text.slice(a, b - a), end))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([path]), pa.array([sum(map(len, writer.counts))], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    _rows.long_ids(docs)
    rows = _rows.texts(docs).repartitionByRange(_store.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    manifest = _store.written(rows.mapInArrow(written, "part long, path string, n_docs long, n_ids long"), "s8b-manifest")
    # one row per partition, however many documents there are
    return [r.asDict() for r in manifest.orderBy("part").collect()]


def read_back(spark: SparkSession, manifest: list[dict], kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    paths = [m["path"] for m in manifest]
    starts = np.concatenate([[0], np.cumsum([m["n_ids"] for m in manifest])]).tolist()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    wanted = spark.createDataFrame([], f"doc_id {kind}").schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(wanted[0].dataType)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at = starts[part]
                for doc_ids, valid, ids in read(paths[part]):
                    n = np.array([len(x) for x in ids], np.int64)
                    columns = [pa.array(doc_ids, mask=~valid).cast(arrow), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array([_tokens.crc32_of(x) for x in ids], pa.int64())]
                    at += int(n.sum())
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(decoded, schema)
