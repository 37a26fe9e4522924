"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded by what it says and how it looks: the learned vectors of its words
(by hash, ``BUCKETS`` of them), and shares of character classes, word lengths
and repetition, through one tanh layer.  Gated attention weights, learned from
the documents' labels alone, form the weighted passage representation, and a
logistic layer scores that.

The model is fitted on the driver from at most ``SAMPLE`` labelled documents,
those with the smallest hashes of doc_id, each with all its passages; scoring
covers every whole text.

A null or empty text is one passage without words and gets a score too; tied
hashes are broken by doc_id; repeated rows get equal scores; an empty table
gives an empty result; without labels of both classes the score is the share
of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _rows, _text

#: The bound of the labelled sample that the model is fitted on, in documents.
SAMPLE = 3000
PASSAGE_WORDS = 64
THRESHOLD = 0.3
#: Word vectors; a word's is that of its hash.
BUCKETS = 4096

_CLASSES = 20


def _class_table() -> np.ndarray:
    table = np.full(256, 19, np.uint8)  # all other control characters
    table[0x80:0xC0] = 18  # continuation bytes
    table[0xC0:] = 17
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\v\f\r", "\n", ".", ",", "!", "?", ";:", "'\"", "()[]{}", "#*", "$%&", "|<>", "+-=/\\_~^@`")):
        table[list(chars.encode())] = k
    return table


_CLASS = _class_table()
FEATURES = _CLASSES + 7


@dataclass
class Bags:
    """Passages of documents: features, their documents' offsets, word buckets and the passages' offsets into them."""

    x: np.ndarray
    off: np.ndarray
    words: np.ndarray
    word_off: np.ndarray

    def of(self, i: int) -> Bags:
        """One document's bag."""
        a, b = int(self.off[i]), int(self.off[i + 1])
        w = self.word_off[a : b + 1]
        return Bags(self.x[a:b], np.array([0, b - a]), self.words[w[0] : w[-1]], w - w[0])


def joined(bags: list[Bags]) -> Bags:
    """Some documents' bags together."""
    ends = lambda parts: np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p) for p in parts]))])
    return Bags(np.concatenate([b.x for b in bags]), ends([b.off for b in bags]), np.concatenate([b.words for b in bags]), ends([b.word_off for b in bags]))


def encode(column: pa.Array) -> Bags:
    """The passages of every text (one at least)."""
    buf, off = _text.as_bytes(column)
    n = len(off) - 1
    ws, we, word_off = _text.words(buf, off)
    n_words = np.diff(word_off)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    passage_off = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(passage_off[-1])
    # the first word of each passage, and its first byte (a text's first passage begins where the text does)
    order = np.arange(total) - np.repeat(passage_off[:-1], n_passages)
    first_word = np.repeat(word_off[:-1], n_passages) + order * PASSAGE_WORDS
    p_words = np.minimum(PASSAGE_WORDS, np.repeat(word_off[1:], n_passages) - first_word)
    begin = np.repeat(off[:-1], n_passages)
    later = order > 0
    begin[later] = ws[first_word[later]]
    of_byte = np.zeros(len(buf) + 1, np.int64)
    np.add.at(of_byte, begin, 1)
    of_byte = np.cumsum(of_byte[:-1]) - 1
    if len(buf):
        hist = np.bincount(of_byte * _CLASSES + _CLASS[buf], minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    else:
        hist = np.zeros((total, _CLASSES))
    size = np.maximum(1.0, hist.sum(1))
    doc = np.repeat(np.arange(n), n_words)
    of_word = np.repeat(passage_off[:-1], n_words) + (np.arange(len(ws)) - np.repeat(word_off[:-1], n_words)) // PASSAGE_WORDS
    per = np.maximum(1, p_words)
    add = lambda v: np.bincount(of_word, weights=v, minlength=total) / per
    lens = (we - ws).astype(np.float64)
    mean = add(lens)
    spread = np.sqrt(np.maximum(0, add(lens * lens) - mean * mean))
    h = _text.hash_spans(buf, ws, we)
    codes, _ = _text.distinct_spans(buf, ws, we, h)
    again = _text.seen_before(codes, doc).astype(np.float64)
    again3, next_same = np.zeros(len(ws)), np.zeros(len(ws))
    if len(ws) > 1:
        next_same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    inside, _ = _text.gram_owner(word_off, 3)
    again3[: len(inside)] = _text.seen_before(_text.gram_codes(codes, 3), doc[: len(inside)]) & inside
    x = np.column_stack([
        np.sqrt(hist / size[:, None]),
        np.log1p(mean), np.log1p(spread), add(again), add(again3), add(next_same),
        np.log1p(p_words) / 4.0, np.log1p(np.repeat(n_words, n_passages)) / 8.0,
    ])
    return Bags(x, passage_off, (h >> _text.U64(52)).astype(np.int64), np.concatenate([[0], np.cumsum(p_words)]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _per_passage(values: np.ndarray, bags: Bags) -> np.ndarray:
    """The values of each passage's words, summed and divided by the root of their number."""
    n = np.diff(bags.word_off)
    out = np.zeros((len(n), values.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(values, bags.word_off[:-1][some], axis=0) / np.sqrt(n[some])[:, None]
    return out


@dataclass
class Model:
    """Weights of the encoder (w, t, b), the gated attention (v, u, a) and the score (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    t: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def parts(self, bags: Bags) -> tuple[np.ndarray, ...]:
        """Passage codes, both attention gates, attention weights, document codes, scores."""
        e = np.tanh(((bags.x - self.mean) / self.scale) @ self.w + _per_passage(self.t[bags.words], bags) + self.b)
        t, g = np.tanh(e @ self.v), _sigmoid(e @ self.u)
        z = (t * g) @ self.a
        starts = bags.off[:-1]
        counts = np.diff(bags.off)
        z = np.exp(z - np.repeat(np.maximum.reduceat(z, starts), counts))
        p = z / np.repeat(np.add.reduceat(z, starts), counts)
        m = np.add.reduceat(e * p[:, None], starts, axis=0)
        return e, t, g, p, m, _sigmoid(m @ self.c + self.d[0])

    def score(self, column: pa.Array) -> np.ndarray:
        return self.parts(encode(column))[-1] if len(column) else np.zeros(0)


NAMES = ("w", "t", "b", "v", "u", "a", "c", "d")


def gradients(model: Model, bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the mean log loss by each weight."""
    e, t, g, p, m, s = model.parts(bags)
    counts = np.diff(bags.off)
    err = (s - labels) / len(labels)
    dm = np.repeat(err[:, None] * model.c, counts, axis=0)
    de = p[:, None] * dm
    dp = (e * dm).sum(1)
    dz = p * (dp - np.repeat(np.add.reduceat(p * dp, bags.off[:-1]), counts))
    dt, dg = dz[:, None] * model.a * g, dz[:, None] * model.a * t
    dt, dg = dt * (1 - t * t), dg * g * (1 - g)
    de = (de + dt @ model.v.T + dg @ model.u.T) * (1 - e * e)
    n = np.diff(bags.word_off)
    of_word = np.repeat(de / np.sqrt(np.maximum(1, n))[:, None], n, axis=0)
    table = np.column_stack([np.bincount(bags.words, weights=of_word[:, j], minlength=BUCKETS) for j in range(of_word.shape[1])])
    return {"c": m.T @ err, "d": np.array([err.sum()]), "a": (t * g).T @ dz, "v": e.T @ dt, "u": e.T @ dg, "w": ((bags.x - model.mean) / model.scale).T @ de, "t": table, "b": de.sum(0)}


def fit(bags: list[Bags], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 24, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Learns a model from bags of passages and the documents' labels (Adam on the log loss)."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate([b.x for b in bags]) if bags else np.zeros((1, FEATURES))
    std = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    model = Model(rows.mean(0), rows.std(0) + 0.02, std(FEATURES, hidden), np.zeros((BUCKETS, hidden)), np.zeros(hidden), std(hidden, gate), std(hidden, gate), std(gate), np.zeros(hidden), np.zeros(1))
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        model.d[0] = np.log((share + 0.01) / (1.01 - share)) if len(labels) else 0.0
        return model
    first = {k: np.zeros_like(getattr(model, k)) for k in NAMES}
    second = {k: np.zeros_like(getattr(model, k)) for k in NAMES}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            grads = gradients(model, joined([bags[i] for i in take]), labels[take])
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k in NAMES:
                gk = grads[k] + decay * getattr(model, k) * (k != "d")
                first[k] += 0.1 * (gk - first[k])
                second[k] += 0.01 * (gk * gk - second[k])
                setattr(model, k, getattr(model, k) - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document lies in the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on the labelled documents outside the held-out fold, ``sample`` of them at most."""
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # the sample's bound is that of the ids that reach the driver and the scan
    ids = [r["id"] for r in chosen.collect()]
    texts = _rows.texts(docs).where(F.col("doc_id").isin(ids))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in _text.pieces(text):
                found = encode(text.slice(lo, hi - lo))
                own = [found.of(i) for i in range(hi - lo)]
                parts = [[b.x.astype(np.float32).tobytes() for b in own], [b.words.astype(np.uint16).tobytes() for b in own], [np.diff(b.word_off).astype(np.uint8).tobytes() for b in own]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), *(pa.array(p, pa.binary()) for p in parts)], ["doc_id", "y", "x", "words", "sizes"])

    # a repeated document does not widen the sample
    found = rows.mapInArrow(passages, f"doc_id {_rows.id_type(docs)}, y double, x binary, words binary, sizes binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x", "words").limit(sample).collect()
    bags = []
    for r in found:
        x = np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(np.float64)
        bags.append(Bags(x, np.array([0, len(x)]), np.frombuffer(r["words"], np.uint16).astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], np.uint8).astype(np.int64))])))
    return fit(bags, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in _text.pieces(text):
                s = model.score(text.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _rows.texts(docs).mapInArrow(scored, f"doc_id {_rows.id_type(docs)}, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score threshold or more, with all their columns."""
    return _rows.keep_where(docs, lambda column: model.score(column) >= threshold)
