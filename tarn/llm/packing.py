"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the capacity; full pieces are
sequences of their own, what remains stays whole.  Groups of about ``WINDOWS``
windows' worth of such pieces are divided into windows: partial partitions are
merged largest difference first, the fullest window of one with the emptiest of
the other, which ends in near-equal windows.  What a window then has beyond the
capacity is cut off its largest pieces and goes to the emptiest windows; where
all windows together cannot hold a group, the window count rises.

Every partition of the input packs what it holds, so nothing is shuffled, and
a task that runs again packs the same pieces into its own sequences.

A null text counts as empty and yields its end id alone; ties of sizes are
broken by arrival; repeated rows are packed as often as they occur; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarn.llm import _rows, _text, _tokens

CAPACITY = 2048
WINDOWS = 96
#: Ids that a group leaves free in each window, on average.
SLACK = 8


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window (0 to k - 1) of each item and the windows' sums, by multiway differencing."""
    n = len(sizes)
    if k == 1 or not n:
        return np.zeros(n, np.int64), np.array([int(sizes.sum())] + [0] * (k - 1))
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        low = int(sums[-1])
        if low:
            sums = sums - low
        merges.append((i, j, order))
        heapq.heappush(heap, (-int(sums[0]), n + len(merges) - 1, sums))
    window = np.zeros(n, np.int64)
    slots: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        i, j, order = merges[at]
        final = slots.pop(n + at)
        for child, place in ((i, order), (j, k - 1 - order)):
            if child < n:
                window[child] = final[np.flatnonzero(place == 0)[0]]
            else:
                mine = np.empty(k, np.int64)
                mine[place] = final
                slots[child] = mine
    return window, np.bincount(window, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Parts of the items as (item, start, length, window): near-equal windows within the capacity, items cut only where one exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    window, sums = differencing(sizes, k)
    own: list[list[int]] = [[] for _ in range(k)]
    for i in np.argsort(sizes, kind="stable").tolist():  # the largest last
        own[window[i]].append(i)
    parts, tails = [], []
    for w, items in enumerate(own):
        excess = int(sums[w]) - capacity
        while excess > 0:
            i = items.pop()
            size = int(sizes[i])
            kept = max(0, size - excess)
            tails.append((i, kept, size - kept))
            if kept:
                parts.append((i, 0, kept, w))
            excess -= size - kept
        parts += [(i, 0, int(sizes[i]), w) for i in items]
    room = [(int(s), w) for w, s in enumerate(sums) if s < capacity]
    heapq.heapify(room)
    for i, start, length in sorted(tails, key=lambda t: -t[2]):
        while length:
            used, w = heapq.heappop(room)
            size = min(length, capacity - used)
            parts.append((i, start, size, w))
            start, length = start + size, length - size
            if used + size < capacity:
                heapq.heappush(room, (used + size, w))
    return parts


class Packer:
    """Packs the documents of one partition; yields arrays of pieces as groups fill."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, n_windows: int = WINDOWS, slack: int = SLACK) -> None:
        self.next, self.capacity = first_id, capacity
        self.target = n_windows * (capacity - min(slack, capacity - 1))
        self.waiting: list[tuple[int, int, int]] = []  # document, start, length
        self.total = 0

    def add(self, doc: int, length: int) -> list[tuple[int, int, int, int, int]]:
        """Takes a document; gives the pieces placed meanwhile as (document, start, length, sequence, offset)."""
        out = []
        full = length // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            out.append((doc, start, self.capacity, self.next, 0))
            self.next += 1
        start = full
        while start < length:
            size = min(length - start, self.target - self.total)
            self.waiting.append((doc, start, size))
            self.total += size
            start += size
            if self.total == self.target:
                out += self.flush()
        return out

    def flush(self) -> list[tuple[int, int, int, int, int]]:
        if not self.waiting:
            return []
        used: dict[int, int] = {}
        out = []
        for i, begin, length, w in windows(np.array([w[2] for w in self.waiting]), self.capacity):
            doc, start, _ = self.waiting[i]
            at = used.get(w, 0)
            out.append((doc, start + begin, length, w, at))
            used[w] = at + length
        number = {w: self.next + i for i, w in enumerate(sorted(used))}
        self.next += len(used)
        self.waiting, self.total = [], 0
        return [(d, s, n, number[w], at) for d, s, n, w, at in out]


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False, memory: int = _tokens.MEMORY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids); a worker remembers ``memory`` words."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokens.coder(tokenizer, memory)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        held: dict[int, tuple[object, np.ndarray, int]] = {}  # documents with pieces that wait
        count = 0

        def rows(placed: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            who = [held[p[0]] for p in placed]
            cut = [h[1][p[1] : p[1] + p[2]] for h, p in zip(who, placed)]
            columns = [
                pa.array([h[0] for h in who], kind), pa.array([p[1] for p in placed], pa.int64()), pa.array([p[2] for p in placed], pa.int64()),
                pa.array([_tokens.crc32_of(c) for c in cut], pa.int64()), pa.array([len(h[1]) for h in who], pa.int64()),
                pa.array([p[3] for p in placed], pa.int64()), pa.array([p[4] for p in placed], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            text, ids_of = batch.column("text"), batch.column("doc_id")
            kind = ids_of.type
            for a, b in _text.pieces(text):
                ids, off = coder.encode(text.slice(a, b - a), end)
                placed = []
                for i, doc_id in enumerate(ids_of.slice(a, b - a).to_pylist()):
                    mine = ids[off[i] : off[i + 1]].copy()
                    held[count] = (doc_id, mine, 0)
                    placed += packer.add(count, len(mine))
                    count += 1
                if placed:
                    yield rows(placed)
                waits = {w[0] for w in packer.waiting}
                held = {k: v for k, v in held.items() if k in waits}
        if packer.waiting:
            yield rows(packer.flush())

    schema = f"doc_id {_rows.id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return _rows.texts(docs).mapInArrow(packed, schema)
