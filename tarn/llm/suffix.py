"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected positions: the minimisers of runs of
``K`` words over windows of ``W`` runs, so any passage of ``PASSAGE`` words
keeps the same position wherever it stands.  Suffixes whose first run occurs
once in the whole corpus repeat nothing and are dropped by a count of the runs'
hashes.  The others are sorted by their words; the words that sorted neighbours
share say how far to the right the members of an interval agree, and members
are told apart to the left one word at a time.  So every passage of ``PASSAGE``
words that stands in two places is found at the one suffix that its own words
select, by its words and not by hashes, and nothing else is.

Documents of one text (by SHA-256) are one: their later ones repeat all of it,
and the first stands for several.  What begins with a run that very many
texts have is split: each of its passages goes by itself, as the
SHA-256 of its words.  These are sorted with their places over all partitions,
and neighbours say which repeat; so no task takes all of such a run, nor all
places of a passage.

A null text counts as empty; texts of fewer words than a passage have no spans;
of equal passages the first is that of the least doc_id (null last) and
position; rows that repeat doc_id and text count once, as do rows without
doc_id of one text; a doc_id that is no integer is an error; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import _rows, _store, _text

PASSAGE = 50
K = 20
W = PASSAGE - K + 1
SIDE = W - 1
#: A run is hot if more texts have it than one task compares in some seconds, with some 20 MB of words.
HOT = 20_000
#: Keys that the places of a repeated text or passage are spread over where they meet what is known of it.
SALTS = 16
#: Bytes of ids and spans to cut that may be broadcast; beyond it they and the texts are shuffled.
BROADCAST_BYTES = 12 << 20

_NO_ID = np.iinfo(np.int64).max
#: Kinds of rows of places: later occurrences, first ones, and all of a text that has copies.
LATER, FIRST, ALL = 0, 1, 2
_PLACES = "doc long, h long, kind int, lo int, hi int"


def _window_least(g: np.ndarray) -> np.ndarray:
    """For each run of W values of g, the place of the (leftmost) least one."""
    best, at, width = g.copy(), np.arange(len(g)), 1
    while width * 2 <= W:
        a, b = best[: len(best) - width], best[width:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[width:], at[: len(at) - width])
        width *= 2
    step = W - width
    if step:
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
    return at


class Suffixes:
    """The kept suffixes of a column's texts, with the words to look around."""

    def __init__(self, column: pa.Array) -> None:
        buf, off = _text.as_bytes(column)
        ws, we, self.word_off = _text.words(buf, off)
        self.n_words = np.diff(self.word_off)
        z = np.zeros(0, np.int64)
        self.key, self.owner, self.at, self.least, self.most = z, z, z, z, z
        self.raw, self.begin = b"", np.zeros(1, np.int64)
        if len(ws) < PASSAGE:
            return
        g = _text.grams(_text.hash_spans(buf, ws, we), K)
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        first = np.arange(len(ws) - PASSAGE + 1)
        first = first[doc[first] == doc[first + PASSAGE - 1]]
        if not len(first):
            return
        #: a suffix's passages follow one another: it is selected by those that begin most to least words before it
        self.at, begin, count = np.unique(_window_least(g)[first], return_index=True, return_counts=True)
        self.most = self.at - first[begin]
        self.least = self.at - first[begin + count - 1]
        self.key, self.owner = g[self.at].view(np.int64), doc[self.at]
        self.buf, self.ws, self.we = buf, ws, we

    @property
    def pos(self) -> np.ndarray:
        """Word positions in the texts."""
        return self.at - self.word_off[self.owner]

    def spell(self) -> None:
        """Lays all words out with one space after each."""
        length = self.we - self.ws + 1
        self.begin = np.concatenate([[0], np.cumsum(length)])
        flat = np.full(int(self.begin[-1]), 0x20, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[self.begin[1:] - 1] = False
        flat[inside] = self.buf[~_text.IS_SPACE[self.buf]]
        self.raw = flat.tobytes()

    def words(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The words a to b - 1 of the column, for many stretches."""
        return [self.raw[x:y] for x, y in zip(self.begin[a].tolist(), self.begin[b].tolist())]


def _identified(docs: DataFrame) -> DataFrame:
    """doc, h (of the text's SHA-256) and text of every row."""
    _rows.long_ids(docs)
    rows = _rows.texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc", _text_key("text").alias("h"), "text")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that suffixes of each text begin with, each once, with their positions; a row without key has the number of words instead."""
    for batch in batches:
        text, ids, hs = (batch.column(c) for c in ("text", "doc", "h"))
        for a, b in _text.pieces(text):
            found = Suffixes(text.slice(a, b - a))
            doc, h = np.asarray(ids.slice(a, b - a)), np.asarray(hs.slice(a, b - a))
            order = np.lexsort((found.key, found.owner))
            key, owner = found.key[order], found.owner[order]
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, np.int64)
            who = np.concatenate([owner[begin], np.arange(b - a)])
            keys = pa.array(np.concatenate([key[begin], np.zeros(b - a, np.int64)]), mask=np.arange(len(who)) >= len(begin))
            ends = np.concatenate([begin, len(key) + np.arange(b - a + 1)]).astype(np.int32)
            pos = np.concatenate([found.pos[order], found.n_words]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(doc[who]), pa.array(h[who]), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))], ["key", "doc", "h", "pos"])


def _chosen(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Suffixes, np.ndarray]]:
    """By pieces of a batch with wanted positions: ids, hashes, suffixes, and which of them are wanted."""
    text, ids, hs, wanted = (batch.column(c) for c in ("text", "doc", "h", "wanted"))
    for a, b in _text.pieces(text, 1 << 20):  # the more at once, the more suffixes with the same words are one row
        found = Suffixes(text.slice(a, b - a))
        if not len(found.at):
            continue
        found.spell()
        part = wanted.slice(a, b - a)
        places = found.word_off[:-1].repeat(np.asarray(part.value_lengths())) + np.asarray(part.flatten())
        yield np.asarray(ids.slice(a, b - a)), np.asarray(hs.slice(a, b - a)), found, np.flatnonzero(np.isin(found.at, places))


def _merged(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each owner, those that overlap or touch as one."""
    if not len(owner):
        return owner, lo, hi
    order = np.lexsort((hi, lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    shift = owner * (int(hi.max(initial=0)) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, (lo + shift)[1:] > reach[:-1] + 1)
    new[1:] |= owner[1:] != owner[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(owner)) - 1
    return owner[begin], lo[begin], (reach - shift)[last]


_WINDOWS = "key long, doc long, h long, pos int, least int, most int, several boolean, before binary, after binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted suffixes: the words from each on, and those before it.

    Suffixes with the same words around are one row, that of the first place.
    The passages of the others are later occurrences, whatever else there is:
    rows without words, from pos to most.
    """
    names = ["key", "doc", "h", "pos", "least", "most", "several", "before", "after"]
    for batch in batches:
        for doc, h, found, use in _chosen(batch):
            place = doc[found.owner[use]], h[found.owner[use]], found.pos[use]
            order = np.lexsort(place[::-1])
            new = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in place])) if len(order) else order.astype(bool)
            use = use[order[new]]  # a repeated row has the places of the other
            owner, at = found.owner[use], found.at[use]
            least, most, pos = found.least[use], found.most[use], found.pos[use]
            after = found.words(at, np.minimum(at + PASSAGE, found.word_off[owner + 1]))
            before = found.words(np.maximum(at - SIDE, found.word_off[owner]), at)
            met: dict[tuple, int] = {}
            code = np.fromiter((met.setdefault(w, i) for i, w in enumerate(zip(before, after, least.tolist(), most.tolist()))), np.int64, len(use))
            own = code == np.arange(len(use))
            several = np.zeros(len(use), bool)
            several[code[~own]] = True
            one = np.flatnonzero(own)
            who, lo, hi = _merged(owner[~own], pos[~own] - most[~own], pos[~own] - least[~own])
            columns = [found.key[use[one]], doc[owner[one]], h[owner[one]], pos[one].astype(np.int32), least[one].astype(np.int32), most[one].astype(np.int32), several[one]]
            whole = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([before[i] for i in one.tolist()], pa.binary()), pa.array([after[i] for i in one.tolist()], pa.binary())], names)
            for i in range(0, len(whole), 2000):
                yield whole.slice(i, 2000)
            if len(who):
                columns = [h[who], doc[who], h[who], lo.astype(np.int32), np.zeros(len(who), np.int32), hi.astype(np.int32), np.zeros(len(who), bool)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(who), pa.binary()), pa.nulls(len(who), pa.binary())], names)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each passage of the wanted suffixes by itself: the SHA-256 of its words, and where it begins."""
    for batch in batches:
        for doc, h, found, use in _chosen(batch):
            n = found.most[use] - found.least[use] + 1
            owner = np.repeat(found.owner[use], n)
            at = np.repeat(found.at[use], n) - _text.ragged(found.least[use], n)
            for i in range(0, len(at), 20_000):
                a, o = at[i : i + 20_000], owner[i : i + 20_000]
                digest = [hashlib.sha256(w).digest() for w in found.words(a, a + PASSAGE)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc[o]), pa.array(h[o]), pa.array((a - found.word_off[o]).astype(np.int32))], ["passage", "doc", "h", "pos"])


def _matrix(column: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and the words of each row as such, -1 where it has no more; backwards: from the last on."""
    buf, off = _text.as_bytes(column)
    ws, we, word_off = _text.words(buf, off)
    codes, _ = _text.distinct_spans(buf, ws, we)
    n = np.diff(word_off)
    out = np.full((len(n), width), -1, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ws)) - np.repeat(word_off[:-1], n)
    out[row, np.repeat(n, n) - 1 - place if backwards else place] = codes
    return n, out


def matches(doc: np.ndarray, h: np.ndarray, pos: np.ndarray, least: np.ndarray, most: np.ndarray, several: np.ndarray, before: pa.Array, after: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, kinds, and first and last beginnings, of the passages that sorted suffixes repeat; ``several`` marks rows that stand for later places too."""
    n = len(doc)
    _, right = _matrix(after, PASSAGE)
    _, left = _matrix(before, SIDE, backwards=True)
    differ = right[1:] != right[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), PASSAGE)
    order = np.lexsort((pos, h, doc))
    step = (doc[order[1:]] != doc[order[:-1]]) | (h[order[1:]] != h[order[:-1]]) | (pos[order[1:]] != pos[order[:-1]])
    place = np.empty(n, np.int64)  # a row that repeats another's place is that one
    place[order] = np.concatenate([[0], np.cumsum(step)])
    state = np.full((n, SIDE + 3), -1, np.int8)
    lefts = np.zeros(n, np.int64)
    width = int(left.max(initial=0)) + 2
    for extend in range(SIDE + 1):
        if extend:
            lefts = pd.factorize(lefts * width + left[:, extend - 1] + 1)[0].astype(np.int64)
        mine = np.flatnonzero((least <= extend) & (extend <= most))
        if not len(mine):
            continue
        # suffixes of an interval whose neighbours share the passage's words, told apart by the words before
        rights = np.concatenate([[0], np.cumsum(shared < PASSAGE - extend)])
        group = lefts[mine] * n + rights[mine]
        by = np.argsort(group, kind="stable")
        new = np.append(True, group[by][1:] != group[by][:-1])
        start = np.flatnonzero(new)
        own = place[mine[by]]
        low, high = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
        of = np.cumsum(new) - 1
        again = (low < high) | np.logical_or.reduceat(several[mine[by]], start)
        state[mine[by], extend + 1] = np.where(again[of], np.where(own == low[of], FIRST, LATER), -1)
    out = []
    for kind in (LATER, FIRST):
        edge = np.diff((state == kind).astype(np.int8), axis=1)
        rows, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        out.append((rows, np.full(len(rows), kind), pos[rows] - (b - 1), pos[rows] - a))  # extends a to b - 1
    return tuple(np.concatenate(x) for x in zip(*out))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to the places of the passages that they repeat."""
    held: pa.Table | None = None

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: np.asarray(table.column(c).combine_chunks())
        bare = np.asarray(table.column("after").combine_chunks().is_null())
        if bare.any():
            doc, h, lo, hi = (get(c)[bare] for c in ("doc", "h", "pos", "most"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(np.full(len(doc), LATER, np.int32)), pa.array(lo), pa.array(hi)], ["doc", "h", "kind", "lo", "hi"])
            table = table.filter(pa.array(~bare))
        if not len(table):
            return
        doc, h = get("doc"), get("h")
        rows, kind, lo, hi = matches(doc, h, get("pos").astype(np.int64), get("least"), get("most"), get("several"), table.column("before").combine_chunks(), table.column("after").combine_chunks())
        for i in range(0, len(rows), 50_000):
            j = slice(i, i + 50_000)
            columns = [doc[rows[j]], h[rows[j]], kind[j].astype(np.int32), lo[j].astype(np.int32), hi[j].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "h", "kind", "lo", "hi"])

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.asarray(held.column("key").combine_chunks())
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut >= 2000:
            yield from done(held.slice(0, cut))
            held = held.slice(cut)
            _text.release()
    if held is not None and len(held):
        yield from done(held)
    _text.release()


class _Document:
    """The places of one document's passages, gathered in order of kind and beginning."""

    def __init__(self, doc: int, h: int) -> None:
        self.who = doc, h
        self.of: list[list[list[int]]] = [[], [], []]

    def add(self, kind: int, lo: int, hi: int) -> None:
        mine = self.of[kind]
        if mine and lo <= mine[-1][1] + 1:
            mine[-1][1] = max(mine[-1][1], hi)
        else:
            mine.append([lo, hi])

    def spans(self) -> Iterator[tuple[int, int, bool]]:
        """Word spans of later and of first occurrences; overlapping or touching passages of a kind are one."""
        later, first, whole = self.of
        if whole:  # each passage that no other document has before is a first one
            first, at = [], 0
            for lo, hi in [*later, [whole[0][1] + 1, 0]]:
                if at < lo:
                    first.append([at, lo - 1])
                at = max(at, hi + 1)
        for kind, places in ((False, later), (True, first)):
            open_: list[int] | None = None
            for lo, hi in places:
                if open_ is not None and lo <= open_[1]:
                    open_[1] = max(open_[1], hi + PASSAGE)
                    continue
                if open_ is not None:
                    yield *open_, kind
                open_ = [lo, hi + PASSAGE]
            if open_ is not None:
                yield *open_, kind


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted places to the spans of each document."""
    now: _Document | None = None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc", "h", "start_word", "end_word", "is_first"])

    for batch in batches:
        for doc, h, kind, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "kind", "lo", "hi"))):
            if now is None or now.who != (doc, h):
                out += [(*now.who, *s) for s in now.spans()] if now else []
                now = _Document(doc, h)
            now.add(kind, lo, hi)
        if len(out) >= 5000:
            yield batch_of(out)
            out = []
    out += [(*now.who, *s) for s in now.spans()] if now else []
    if out:
        yield batch_of(out)


def _beside(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """The rows with what is known of their key; a hot key's rows are joined by several tasks."""
    known = known.withColumnRenamed(on, "__of").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__of_salt"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc", "h"), F.lit(SALTS)).cast("int"))
    return salted.join(known.hint("merge"), (F.col(on) == F.col("__of")) & (F.col("__salt") == F.col("__of_salt"))).drop("__of", "__of_salt", "__salt")


def _with_wanted(rows: DataFrame, positions: DataFrame) -> DataFrame | None:
    """The texts with positions of theirs, of each text the first document, beside these; None if there are no positions."""
    wanted = positions.groupBy(F.col("h").alias("k")).agg(F.min("doc").alias("d"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("wanted"))
    wanted = _store.written(wanted, "wanted")
    if wanted.isEmpty():
        return None
    return rows.join(wanted.hint("merge"), (F.col("doc") == F.col("d")) & (F.col("h") == F.col("k"))).drop("d", "k")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted passages: whether the ones before and after are the same (null at the partition's ends, where the passage itself stands too)."""
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None
    begun = False

    def out(table: pa.Table, n: int, last: bool) -> pa.RecordBatch:
        """Marks of the first n rows; the row before them is the table's first unless they begin the partition."""
        skip = int(begun)
        passage = table.column("passage").to_pylist()
        same = [x == y for x, y in zip(passage, passage[1:])]
        before = ([] if begun else [None]) + same[: n - 1 + skip]
        after = same[skip : skip + n] + ([None] if last else [])
        whole = table.slice(skip, n).combine_chunks()
        ends = [p if b is None or a is None else None for p, b, a in zip(passage[skip:], before, after)]
        columns = [*(pa.array(np.asarray(whole.column(c).combine_chunks())) for c in ("doc", "h", "pos")), pa.array(before, pa.bool_()), pa.array(after, pa.bool_()), pa.array(ends, pa.binary()), pa.array(np.full(n, part, np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc", "h", "pos", "before", "after", "end", "part"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        n = len(held) - int(begun) - 1  # a row waits for the one after it
        if n > 0:
            yield out(held, n, False)
            held = held.slice(len(held) - 2)
            begun = True
    if held is not None and len(held) > int(begun):
        yield out(held, len(held) - int(begun), True)


def _sorted_passages(passages: DataFrame) -> DataFrame:
    """The places of passages that stand in several, by sorting all of them with their places over all partitions."""
    order = ["passage", "doc", "h", "pos"]
    marked = passages.repartitionByRange(_store.partitions(passages.sparkSession), *order).sortWithinPartitions(*order)
    marked = _store.written(marked.mapInArrow(_neighbours, "doc long, h long, pos int, before boolean, after boolean, end binary, part int"), "passages")
    # the first and the last passage of each partition
    ends = sorted((r["part"], r["before"] is not None, bytes(r["end"])) for r in marked.where("end IS NOT NULL").select("part", "before", "end").collect())
    met = {a[0]: (b[0], a[2] == b[2]) for a, b in zip(ends, ends[1:]) if a[0] != b[0]}
    goes_on = [p for p, (_, same) in met.items() if same]
    went_on = [q for q, same in met.values() if same]
    before, after = F.coalesce("before", F.col("part").isin(went_on)), F.coalesce("after", F.col("part").isin(goes_on))
    kept = marked.withColumns({"same": before, "again": before | after}).where("again")
    return kept.select("doc", "h", F.when(F.col("same"), LATER).otherwise(FIRST).alias("kind"), F.col("pos").alias("lo"), F.col("pos").alias("hi"))


def places(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, h, start_word, end_word, is_first: the spans of documents by id (or a number for none) and text."""
    n = _store.partitions(docs.sparkSession)
    rows = _identified(docs)
    kept = _store.written(rows.mapInArrow(_kept, "key long, doc long, h long, pos array<int>"), "suffixes")
    # documents of one text are one: the one of least doc_id
    pairs = kept.where("key IS NULL").select("doc", "h", F.get("pos", F.lit(0)).alias("n_words")).distinct()
    pairs = _store.written(pairs, "documents")
    copied = pairs.groupBy("h").agg(F.min("doc").alias("first"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copied = _store.written(copied, "copied")
    kept = kept.where("key IS NOT NULL")
    # a run repeats where it stands in two texts or at two places of one
    counts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max(F.size("pos")).alias("most")).where("lo < hi OR most > 1").select("key", "n")
    counts = _store.written(counts, "runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # no more than eight times the partitions' number have more than an eighth of a partition's suffixes: they go by a list, all others by a join
    share = max(hot, total / (8 * n))
    largest = [r["key"] for r in counts.where(F.col("n") > share).collect()]
    # always by a shuffle: the list of repeated runs grows with the corpus
    known = kept.join(counts.where(F.col("n") <= share).withColumnRenamed("key", "run").hint("merge"), F.col("key") == F.col("run"))
    parts = []
    texts = _with_wanted(rows, known.where(F.col("n") <= hot).select("doc", "h", "pos"))
    if texts is not None:
        windows = texts.mapInArrow(_windows, _WINDOWS)
        windows = windows.repartition(n, "key").sortWithinPartitions("key", "after")
        parts.append(windows.mapInArrow(_compare, _PLACES))
    if not counts.where(F.col("n") > hot).isEmpty():
        found = known.where(F.col("n") > hot).select("doc", "h", "pos").union(kept.where(F.col("key").isin(largest)).select("doc", "h", "pos"))
        passages = _with_wanted(rows, found).mapInArrow(_passages, "passage binary, doc long, h long, pos int")
        parts.append(_sorted_passages(passages.distinct()))
    last = (F.col("n_words") - PASSAGE).alias("hi")
    parts.append(copied.where(F.col("n_words") >= PASSAGE).select(F.col("first").alias("doc"), "h", F.lit(ALL).alias("kind"), F.lit(0).alias("lo"), last))
    later = _beside(pairs.select("doc", "h"), copied, "h").where((F.col("doc") > F.col("first")) & (F.col("n_words") >= PASSAGE))
    parts.append(later.select("doc", "h", F.lit(LATER).alias("kind"), F.lit(0).alias("lo"), last))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.repartition(n, "doc", "h").sortWithinPartitions("doc", "h", "kind", "lo")
    return whole.mapInArrow(_joined, "doc long, h long, start_word int, end_word int, is_first boolean")


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, is_first: what each document has of repeated passages, the first occurrence apart from the later ones."""
    found = places(docs, hot)
    return found.select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "start_word", "end_word", "is_first")


def cut(text: str | None, found: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and the white space after them."""
    if text is None or not found:
        return text
    raw = text.encode()
    ws, _, _ = _text.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    starts = np.append(ws, len(raw)).tolist()
    out, at = [], 0
    for s, e in sorted(found):
        s, e = min(s, len(starts) - 1), min(e, len(starts) - 1)
        out.append(raw[at : max(at, starts[s])])
        at = max(at, starts[e])
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every document without the later occurrences of repeated passages; n_chars, where there is one, follows."""
    found = places(docs).where("NOT is_first").groupBy(F.col("doc").alias("of"), F.col("h").alias("of_h")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    found = _store.written(found, "cuts")
    n, total = found.agg(F.count(F.lit(1)), F.sum(F.size("cuts"))).first()
    small = 60 * n + 8 * (total or 0) <= broadcast_bytes
    names, at, key = docs.columns, docs.columns.index("text"), docs.columns.index("doc_id")
    held = [f"c{i}" for i in range(len(names))]
    inner = docs.toDF(*held)
    on = (F.coalesce(F.col(f"c{key}").cast("long"), F.lit(_NO_ID)) == F.col("of")) & (_text_key(f"c{at}") == F.col("of_h"))
    joined = inner.join(F.broadcast(found) if small else found.hint("merge"), on, "left").drop("of", "of_h")
    length = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else -1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            cuts = columns.pop()
            if cuts.null_count < len(cuts):
                texts = batch.column(at).to_pylist()
                pairs = cuts.to_pylist()
                new = [cut(t, [(x["start_word"], x["end_word"]) for x in c]) if c else t for t, c in zip(texts, pairs)]
                columns[at] = pa.array(new, columns[at].type)
                if length >= 0:
                    old = columns[length].to_pylist()
                    columns[length] = pa.array([o if not c else len(t or "") for o, c, t in zip(old, pairs, new)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, held)
            _text.release()

    schema = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(held, docs.schema)])
    return joined.mapInArrow(rows, schema).toDF(*names)
