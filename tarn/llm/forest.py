"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text's set is that of its runs of ``GRAM`` words (a text of fewer words is one
run).  Texts with equal word sequences are one class from the start: one
representative, the rest counted.  Each of ``TREES`` prefix tries holds every
representative by ``DEPTH`` minhash values.

Representatives that share a prefix of the full depth in some trie are
compared first.  From the similarities of the pairs found so, and the chance
that a pair of that similarity shares such a prefix, follows how many pairs
there are (each pair found stands for the inverse of its chance).  As long as
the share found is below ``RECALL``, the prefix is shortened by a value and the
pairs that this adds are compared.  The pair that would be least likely to be
found counts as one more, so without any pair the prefix is as short as the
threshold alone asks for.

Only pairs of a prefix group are compared, each pair once: in the first trie
where it shares the prefix.  First the group's signatures meet, in blocks, and
say which texts have a partner there; only those texts' runs are then shuffled
and compared by exact set intersection, again in blocks, bounded by texts and
by runs.  What leaves a block is one row per text (its number of links and its
class there), never the pairs.  Classes are closed over verified links alone.

A pair whose signatures agree in fewer than ``PLAUSIBLE`` of all values is not
compared: for a pair at the threshold a chance below 1 in 100,000.

A null text counts as empty; empty texts are copies of one another; repeated
rows count as copies, and unlike texts under one doc_id as documents of their
own; documents without doc_id take part, but do not name a class unless it has
no others (null then); a doc_id that is no integer is an error; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import _components, _rows, _store, _text

GRAM = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.9995
#: Share of all minhash values that pairs worth comparing have in common.
PLAUSIBLE = 0.61
#: Signatures of a block of a prefix group: an eighth of the group within these bounds.
SIGNATURES = (512, 8192)
#: Runs that one block of texts holds, about, and texts.
BLOCK = 30_000
TEXTS = 256
#: Keys that the documents of a class are spread over where they meet what is known of it.
SALTS = 16
#: Rows of fixed width (some 60 bytes at most) that may be broadcast, 12 MB; beyond it they and the texts are shuffled.
BROADCAST_ROWS = 200_000

U64 = np.uint64
#: Stands for a missing doc_id inside.
_NO_ID = (1 << 63) - 1
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_ODD = (_RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def found_chance(similarity: np.ndarray | float, d: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two texts of a similarity share d values in some trie."""
    return 1 - (1 - similarity**d) ** trees


def stands_for(similarity: np.ndarray) -> np.ndarray:
    """How many pairs the found ones stand for, for prefixes of 1 to DEPTH values."""
    return np.array([(1 / found_chance(similarity, d)).sum() for d in range(1, DEPTH + 1)])


def shingles(column: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs' hashes, n + 1 offsets of the texts' runs, and two 64-bit keys of each text's word sequence."""
    buf, off = _text.as_bytes(column)
    ws, we, word_off = _text.words(buf, off)
    h = _text.hash_spans(buf, ws, we)
    n_words = np.diff(word_off)
    order = (np.arange(len(h)) - np.repeat(word_off[:-1], n_words)).astype(np.uint64)
    salted = _text.mix64(h + order * U64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(salted, out=sums[1:])
    key1 = _text.mix64(sums[word_off[1:]] - sums[word_off[:-1]] + n_words.astype(np.uint64))
    np.cumsum(_text.mix64(salted ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    key2 = _text.mix64(sums[word_off[1:]] - sums[word_off[:-1]])
    inside, doc = _text.gram_owner(word_off, gram)
    g = _text.grams(h, gram)[inside] if len(inside) else np.zeros(0, np.uint64)
    owner = doc[: len(inside)][inside]
    short = np.flatnonzero((n_words < gram) & (n_words > 0))
    if len(short):
        owner = np.concatenate([owner, short])
        g = np.concatenate([g, key1[short]])
        again = np.argsort(owner, kind="stable")
        owner, g = owner[again], g[again]
    return g, np.searchsorted(owner, np.arange(len(n_words) + 1)), key1, key2


def signatures(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """TREES * DEPTH 16-bit minhash values of each text that has runs; rows of others are 0."""
    n = len(off) - 1
    out = np.zeros((n, TREES * DEPTH), np.uint16)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    x, starts = (g >> U64(32)).astype(np.uint32), off[:-1][full]
    for i in range(TREES * DEPTH):
        y = x ^ _XOR[i]
        y *= _ODD[i]
        out[full, i] = np.minimum.reduceat(y, starts).astype(np.uint16)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    _rows.long_ids(docs)
    return _rows.texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text as it stands), k1, k2 (the word sequence), n (runs) and sig of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in _text.pieces(text):
                g, off, k1, k2 = shingles(text.slice(a, b - a))
                sig = signatures(g, off)
                width = sig.shape[1] * 2
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.arange(b - a + 1) * width).astype(np.int32)), pa.py_buffer(sig.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("h").slice(a, b - a), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(off)), packed], ["doc_id", "h", "k1", "k2", "n", "sig"])

    rows_of = _numbered(docs)
    return rows_of.mapInArrow(rows, "doc_id long, h long, k1 long, k2 long, n long, sig binary")


class _Sets:
    """Union-find over 0 to n - 1; roots are the least members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def _prefixes(sig: np.ndarray, d: int) -> np.ndarray:
    """Hashes of each text's first d values in each trie; the trie's number is part of them."""
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2])
    for j in range(d):
        key = _text.mix64(key * U64(0xD6E8FEB86659FD93) + sig[:, :, j].astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    return key


def _signatures(column: pa.Array) -> np.ndarray:
    """A column of packed signatures as texts by tries by values."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), TREES, DEPTH)


def _entries(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """A row for each text and trie: trie, prefix, the value after the prefix, and the text."""
    for batch in batches:
        if not len(batch):
            continue
        sig = _signatures(batch.column("sig"))
        n = len(sig)
        after = sig[:, :, d] if d < DEPTH else np.zeros((n, TREES), np.uint16)
        columns = np.tile(np.arange(TREES, dtype=np.int32), n), _prefixes(sig, d).reshape(-1).view(np.int64), after.reshape(-1).astype(np.int32), np.repeat(np.asarray(batch.column("rep")), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "prefix", "after", "rep"])


class _Pairs:
    """Which pairs of texts a trie compares at a prefix length."""

    def __init__(self, d: int, sig: np.ndarray) -> None:
        self.d, self.sig = d, sig
        self.short = _prefixes(sig, d)
        self.long = _prefixes(sig, d + 1) if d < DEPTH else None

    def own(self, a: np.ndarray, b: np.ndarray, tree: np.ndarray | int) -> np.ndarray:
        """Whether ``tree`` is the first in which a and b share the prefix, and no longer one has brought them together."""
        shared = self.short[a] == self.short[b]
        out = shared.any(-1) & (shared.argmax(-1) == tree)
        if self.long is not None:
            out &= ~(self.long[a] == self.long[b]).any(-1)
        return out

    def plausible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        flat = self.sig.reshape(len(self.sig), -1)
        return (flat[a] == flat[b]).sum(-1) >= PLAUSIBLE * flat.shape[1]


def _offsets(group: np.ndarray, size: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of one group, groups being runs of equal numbers, some at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    live = np.arange(len(group))
    for offset in range(1, len(group)):
        live = live[live + offset < len(group)]
        live = live[group[live] == group[live + offset]]
        if not len(live):
            break
        held.append((live, live + offset))
        count += len(live)
        if count >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _partners(d: int):
    """Sorted rows of blocks of prefix groups to the texts that have a partner in theirs."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: np.asarray(table.column(c).combine_chunks())
        prefix, i, j, block, tree, rep = (get(c) for c in ("prefix", "i", "j", "block", "tree", "rep"))
        pairs = _Pairs(d, _signatures(table.column("sig").combine_chunks()))
        new = np.append(True, (prefix[1:] != prefix[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        has = np.zeros(len(rep), bool)
        for a, b in _offsets(np.cumsum(new)):
            use = ((block[a] != block[b]) | (i[a] == j[a])) & (rep[a] != rep[b])
            a, b = a[use], b[use]
            use = pairs.plausible(a, b)
            a, b = a[use], b[use]
            use = pairs.own(a, b, tree[a])
            has[a[use]] = has[b[use]] = True
        at = np.flatnonzero(has)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(prefix[at]), pa.array(tree[at]), pa.array(rep[at])], ["prefix", "tree", "rep"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [np.asarray(held.column(c).combine_chunks()) for c in ("prefix", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new) and new[-1] >= 2000:  # the last group may go on in the next batch
                yield from done(held.slice(0, new[-1]))
                held = held.slice(new[-1])
        if held is not None and len(held):
            yield from done(held)

    return rows


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """A copy of each row of a group for each pair of blocks that its own is in; rows of a pair side by side."""
    n = _store.partitions(rows.sparkSession)
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return placed.repartition(n, "prefix", "i", "j").sortWithinPartitions("prefix", "i", "j", "rep")


def partners(reps: DataFrame, d: int) -> DataFrame:
    """prefix, tree, rep: the texts that have a partner in a group of texts with d values in common, which no longer prefix gave them."""
    found = reps.where("n > 0").select("rep", "sig").mapInArrow(lambda b: _entries(b, d), "tree int, prefix long, after int, rep long")
    groups = found.groupBy(F.col("prefix").alias("of")).agg(F.count(F.lit(1)).alias("m"), F.min("after").alias("lo"), F.max("after").alias("hi"))
    # texts that all share one value more have met
    groups = groups.where("m > 1" if d == DEPTH else "m > 1 AND lo < hi").select("of", "m")
    live = found.join(groups, F.col("prefix") == F.col("of")).select("prefix", "tree", "rep", "m")
    live = _store.written(live, "groups")
    low, high = SIGNATURES
    block = F.least(F.greatest(F.ceil(F.col("m") / 8), F.lit(low)), F.lit(high))
    signed = live.join(reps.select(F.col("rep").alias("r"), "sig"), F.col("rep") == F.col("r")).drop("r")
    placed = _in_blocks(signed, F.ceil(F.col("m") / block))
    # a text of several pairs of blocks is named by each
    out = _store.written(placed.mapInArrow(_partners(d), "prefix long, tree int, rep long").distinct(), "partners")
    _store.forget(live)
    return out


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sizes of the intersections of each set of ``first`` with each of ``second``, some rows at a time."""
    used = np.unique(np.concatenate([first, second]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    words, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a run of one text alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    total = int(shared.sum())
    sums = np.zeros((len(first), len(second)), np.float32)
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], code[by]
    width = max(256, min(4096, (4 << 20) // max(1, len(used))))
    for lo in range(0, total, width):
        x, y = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(used), min(width, total - lo)), np.float32)
        m[owner[x:y], code[x:y] - lo] = 1
        sums += m[place[first]] @ m[place[second]].T
    return sums


def verify(weights: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], pair: tuple[int, int], threshold: float, own: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, chance: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Links of each text (weighted by copies), its least linked class, the pairs found and how many they stand for at each prefix length, from the pairs of one pair of blocks."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    links = np.zeros(n, np.int64)
    union = _Sets(n)
    first, second = np.flatnonzero(blocks == pair[0]), np.flatnonzero(blocks == pair[1])
    count, expected = 0, np.zeros(DEPTH)
    if len(first) and len(second):
        both = _common(sets, first, second).astype(np.float64)
        total = size[first][:, None] + size[second][None, :] - both
        hit = both >= threshold * total - 1e-6
        hit &= (first[:, None] < second[None, :]) if pair[0] == pair[1] else True
        x, y = np.nonzero(hit)
        a, b = first[x], second[y]
        if own is not None:
            use = own(a, b)
            x, y, a, b = x[use], y[use], a[use], b[use]
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        for i, j in zip(a.tolist(), b.tolist()):
            union.join(i, j)
        count = len(a)
        if chance is not None and count:
            expected = chance(both[x, y] / total[x, y])
    return links, union.roots(), count, expected


def _verify_groups(threshold: float, d: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            order = sorted(range(len(held)), key=lambda i: held[i][0])
            reps = np.array([held[i][0] for i in order], np.int64)
            pairs = _Pairs(d, np.frombuffer(b"".join(held[i][4] for i in order), "<u2").reshape(len(order), TREES, DEPTH))
            links, root, count, expected = verify(
                np.array([held[i][1] for i in order]), np.array([held[i][2] for i in order]), [np.frombuffer(held[i][3], "<u8") for i in order], key[1:], threshold,
                lambda a, b: pairs.own(a, b, held[0][5]), stands_for,
            )
            has = np.flatnonzero(links > 0)
            if len(has):
                first = [expected.tolist()] + [None] * (len(has) - 1)  # a pair of blocks counts its pairs once
                yield pa.RecordBatch.from_arrays([pa.array(reps[has]), pa.array(reps[root[has]]), pa.array(links[has]), pa.array(np.where(np.arange(len(has)) == 0, count, 0)), pa.array(first, pa.list_(pa.float64()))], ["u", "v", "links", "pairs", "expected"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("prefix", "i", "j", "rep", "copies", "block", "runs", "sig", "tree")]
            for prefix, i, j, rep, copies, block, runs, sig, tree in zip(*columns):
                if (prefix, i, j) != key:
                    yield from done()
                    held, key = [], (prefix, i, j)
                if not held or held[-1][0] != rep:
                    held.append((rep, copies, block, runs, sig, tree))
        yield from done()

    return rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each text that its row's node names, as bytes, beside the other columns."""
    for batch in batches:
        text = batch.column("text")
        rest = [c for c in batch.schema.names if c != "text"]
        for a, b in _text.pieces(text):
            g, off, node, _ = shingles(text.slice(a, b - a))
            own = np.flatnonzero(node.view(np.int64) == np.asarray(batch.column("rep").slice(a, b - a)))
            runs = pa.array([np.unique(g[off[i] : off[i + 1]]).astype("<u8").tobytes() for i in own.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(pa.array(own)) for c in rest), runs], [*rest, "runs"])


def linked_at(docs: DataFrame, reps: DataFrame, d: int, threshold: float, block: int, texts: int, broadcast_rows: int) -> DataFrame:
    """Links of the texts that prefixes of d values bring together: u, v (a linked text), links, pairs, expected."""
    found = partners(reps, d)
    known = reps.select(F.col("rep").alias("r"), "first", "copies", "n", "sig")
    sizes = found.join(known.select("r", "n"), F.col("rep") == F.col("r")).groupBy(F.col("prefix").alias("of")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("runs"))
    sizes = sizes.select("of", F.greatest(F.ceil(F.col("m") / texts), F.ceil(F.col("runs") / block)).cast("int").alias("blocks"))
    # a text is in a group of each trie at most
    places = found.join(sizes, F.col("prefix") == F.col("of")).groupBy(F.col("rep")).agg(F.collect_list(F.struct("prefix", "tree", "blocks")).alias("places"))
    places = _store.written(places, "places")
    # only ids go to where the texts are; what the texts become is joined with the rest
    firsts = _store.written(places.join(known, F.col("rep") == F.col("r")).select("rep", "first"), "firsts")
    on = F.col("doc_id") == F.col("first")
    rows = _numbered(docs).join(F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts.hint("merge"), on).drop("doc_id", "h", "first")
    runs = _store.written(rows.mapInArrow(_runs, "rep long, runs binary"), "runs")
    placed = runs.join(places.withColumnRenamed("rep", "p"), F.col("rep") == F.col("p")).join(known.select("r", "copies", "sig"), F.col("rep") == F.col("r"))
    placed = placed.select("rep", "copies", "sig", "runs", F.inline("places"))
    placed = _in_blocks(placed, F.col("blocks"))
    out = _store.written(placed.mapInArrow(_verify_groups(threshold, d), "u long, v long, links long, pairs long, expected array<double>"), "links")
    _store.forget(found, places, firsts, runs)
    return out


def links(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, texts: int = TEXTS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int, float]:
    """All links found, the length that prefixes were shortened to, and the share of the pairs that follows from them."""
    tables: list[DataFrame] = []
    d, share = DEPTH + 1, 0.0
    while share < recall and d > 1:
        d -= 1
        tables.append(linked_at(docs, reps, d, threshold, block, texts, broadcast_rows))
        # what shares a longer prefix shares this one too, so all pairs so far count at this length's chance
        row = reduce(DataFrame.union, tables).agg(F.sum("pairs").alias("pairs"), F.sum(F.get("expected", F.lit(d - 1))).alias("expected")).first()
        share = ((row["pairs"] or 0) + 1) / ((row["expected"] or 0.0) + 1 / float(found_chance(threshold, d)))
    return reduce(DataFrame.union, tables), d, share


def representatives(sketched: DataFrame) -> DataFrame:
    """One row for each word sequence: rep (its first key), k2, first (the document that shows its text, the one of least doc_id), copies, n, sig."""
    reps = sketched.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min("sig").alias("sig"))
    return _store.written(reps.withColumnRenamed("k1", "rep"), "reps")


def _classified(docs: DataFrame, threshold: float, recall: float, block: int, texts: int, broadcast_rows: int) -> DataFrame:
    """doc_id, h (a hash of the text as it stands), class (a word sequence of it), n_links of every document."""
    sketched = _store.written(sketch(docs), "sketch")
    reps = representatives(sketched)
    linked, _, _ = links(docs, reps, threshold, recall, block, texts, broadcast_rows)
    roots = _components.components(linked.select("u", "v"))
    counts = linked.groupBy(F.col("u").alias("of")).agg(F.sum("links").alias("links"))
    named = reps.select("rep", "k2", "copies").join(roots, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("of"), "left")
    named = named.select(F.col("rep").alias("r1"), F.col("k2").alias("r2"), F.coalesce("root", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketched.select("doc_id", "h", "k1", "k2").join(named, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("doc_id", "h", "class", "n_links")
    out = _store.written(out, "classified")
    _store.forget(sketched, reps)
    return out


def _beside_class(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows of classes of several with an aggregate of their class; null beside all others.

    The rows of a class are spread over ``SALTS`` keys, so a large class is joined by several tasks.
    """
    several = rows.groupBy(F.col("class").alias("of")).agg(value.alias(name), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    several = several.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int"))
    return salted.join(several, (F.col("class") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left").drop("of", "of_salt", "salt")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, texts: int = TEXTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links (documents as similar as the threshold) of every document."""
    rows = _classified(docs, threshold, recall, block, texts, broadcast_rows)
    joined = _beside_class(rows, F.min("doc_id"), "least")
    return joined.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.nullif(F.coalesce("least", "doc_id"), F.lit(_NO_ID)).alias("class_id"), "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One document of each class, that of the least doc_id, with all its columns.

    Unlike texts under one doc_id are documents of their own, here too; of rows
    of one doc_id and text one stays, and one of a class without any doc_id.
    """
    rows = _classified(docs, threshold, RECALL, BLOCK, TEXTS, broadcast_rows)
    rows = _store.written(rows.groupBy("class", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows")), "members")
    judged = _beside_class(rows, F.min(F.struct("doc_id", "h")), "first")
    judged = judged.select(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), "rows", F.coalesce(F.struct("doc_id", "h") != F.col("first"), F.lit(False)).alias("lost"))
    judged = _store.written(judged.where("lost OR rows > 1"), "judged")
    lost, again = judged.where("lost").select("of_id", "of_h"), judged.where("NOT lost").select("of_id", "of_h")
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    held = inner.withColumns({"__id": F.coalesce(key.cast("long"), F.lit(_NO_ID)), "__h": F.xxhash64(text.cast("string"))})
    on = (F.col("__id") == F.col("of_id")) & (F.col("__h") == F.col("of_h"))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df.hint("merge")
    out = held.join(small(lost), on, "left_anti")
    if not again.isEmpty():
        again = small(again)
        out = out.join(again, on, "left_anti").union(held.join(again, on, "left_semi").dropDuplicates(["__id", "__h"]))
    return out.select(*inner.columns).toDF(*docs.columns)
