import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import _rows, _store, _text, _tokens, bpe, mil, multiset, packing, queries, rules, simple8b

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# rules


def brute_measures(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in rules.SYMBOLS for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_bangs": text.count("!"), "n_upper": sum("A" <= c <= "Z" for c in text),
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab!\n \té*A\x0b\x1c", max_size=40), max_size=5))
def test_measures(texts):
    found = rules.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in found.items()} == brute_measures(t)


def test_ledger_policies_and_ablations(awkward, nothing):
    entries = rules.ledger(awkward)
    got = rules.verdicts(entries).collect()
    assert len(got) == 17
    texts = dict(rows_of(awkward))
    for r in got:
        m = brute_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in m} == m
        assert r["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {4, 5, 6, 8, 9, 12} == kept
    assert {r["doc_id"] for r in rules.keep(awkward).collect()} == kept
    assert rules.keep(awkward).columns == awkward.columns
    bits = [r["failed_bits"] for r in got]
    for r in rules.ablations(entries).collect():
        b = rules.bit(r["rule"])
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    assert rules.verdicts(rules.ledger(nothing)).count() == 0 and rules.keep(nothing).count() == 0


# classifier


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op1_quality_mil(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert queries.op1_quality_mil(spark, sf).count() == docs.count()


def test_classifier_cases(awkward, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    model = mil.train(awkward, labels)
    got = mil.score(awkward, model).collect()
    assert len(got) == 17 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert by[0] == by[1] and by[4] == by[5]
    assert mil.keep(awkward, model).columns == awkward.columns
    assert mil.score(nothing, model).count() == 0
    blank = mil.train(awkward, labels.limit(0))
    assert {r["score"] for r in mil.score(awkward, blank).collect()} == {0.5}


def random_bags(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = int(rng.integers(1, 6))
        sizes = rng.integers(0, 9, k)
        out.append(mil.Bags(rng.normal(size=(k, mil.FEATURES)), np.array([0, k]), rng.integers(0, mil.BUCKETS, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    bags, y = mil.joined(random_bags(7)), rng.integers(0, 2, 7).astype(float)
    model = mil.fit(random_bags(4), np.array([0.0, 1.0, 0.0, 1.0]), hidden=5, gate=3, epochs=2)

    def loss():
        s = model.parts(bags)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, grad in mil.gradients(model, bags, y).items():
        weight = getattr(model, name)
        flat, g = weight.reshape(-1), grad.reshape(-1)
        places = rng.choice(len(flat), min(12, len(flat)), replace=False)
        if name == "t":
            hidden = weight.shape[1]
            places = np.concatenate([places, bags.words[:6] * hidden + np.arange(6) % hidden])
        for i in places.tolist():
            at = flat[i]
            flat[i] = at + 1e-6
            up = loss()
            flat[i] = at - 1e-6
            down = loss()
            flat[i] = at
            assert abs((up - down) / 2e-6 - g[i]) < 1e-7


def brute_score(model, text):
    """One document's score, passage by passage and word by word."""
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    raw = text.encode()
    w = [raw[a:b] for a, b in spans]
    size, rows, words_of = mil.PASSAGE_WORDS, [], []
    for k in range(max(1, -(-len(w) // size))):
        mine = w[k * size : (k + 1) * size]
        begin = 0 if k == 0 else spans[k * size][0]
        end = spans[(k + 1) * size][0] if (k + 1) * size < len(w) else len(raw)
        hist = np.zeros(20)
        for c in raw[begin:end]:
            hist[mil._CLASS[c]] += 1
        n = max(1, len(mine))
        lens = [len(x) for x in mine]
        mean = sum(lens) / n
        spread = max(0.0, sum(x * x for x in lens) / n - mean * mean) ** 0.5
        at = range(k * size, k * size + len(mine))
        again = sum(w[i] in w[:i] for i in at) / n
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again3 = sum(i < len(grams) and grams[i] in grams[:i] for i in at) / n
        same = sum(i > 0 and w[i] == w[i - 1] for i in at) / n
        rows.append([*np.sqrt(hist / max(1.0, hist.sum())), np.log1p(mean), np.log1p(spread), again, again3, same, np.log1p(len(mine)) / 4, np.log1p(len(w)) / 8])
        words_of.append(mine)
    weights, codes = [], []
    for x, mine in zip(rows, words_of):
        z = ((np.array(x) - model.mean) / model.scale) @ model.w + model.b
        for word in mine:
            h = int(_text.hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
            z = z + model.t[h >> 52] / len(mine) ** 0.5
        e = np.tanh(z)
        codes.append(e)
        weights.append(np.exp((np.tanh(e @ model.v) / (1 + np.exp(-(e @ model.u)))) @ model.a))
    m = sum(p * e for p, e in zip(weights, codes)) / sum(weights)
    return 1 / (1 + np.exp(-(m @ model.c + model.d[0])))


def test_scores_equal_brute_force(spark, awkward):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = mil.train(docs, labels)
    for rows in (awkward, docs.where("doc_id % 4 = 0")):
        texts = dict(rows_of(rows))
        for r in mil.score(rows, model).collect():
            if len(texts[r["doc_id"]]) < 20_000:
                assert abs(r["score"] - brute_score(model, texts[r["doc_id"]])) < 1e-9


def test_words_alone_tell_texts_apart(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = ["".join(letters[rng.permutation(26)[:6]]) for _ in range(400)]
    text = lambda bad: " ".join(vocabulary[i + 200 * (bad and j % 3 == 0)] for j, i in enumerate(rng.integers(0, 200, 150)))
    rows = [(i, text(i % 2 == 0), i % 2) for i in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in mil.score(docs, mil.train(docs, labels)).collect()}
    held = [(got[i] >= 0.5, y == 1) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_all_passages_of_a_labelled_document_count(spark):
    long = " ".join(f"w{i % 97}" for i in range(64 * 700))
    docs = spark.createDataFrame([(i, long if i == 1 else "short text") for i in range(1, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    seen = []
    keep, mil.fit = mil.fit, lambda bags, y: seen.append([len(b.x) for b in bags])
    try:
        mil.train(docs, labels)
    finally:
        mil.fit = keep
    assert max(seen[0]) == 700


# token ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 40), max_size=300), st.sampled_from([4, 7, 64]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    coded, offsets = simple8b.encode(v, block)
    assert (simple8b.decode(coded, offsets, len(v), block) == v).all()


def test_simple8b_files(spark, awkward, nothing, tokenizer):
    manifest = simple8b.write(awkward, WORD_BPE, _store.shared(spark, "t"))
    got = simple8b.read_back(spark, manifest, with_ids=True).collect()
    assert len(got) == 17
    texts, start = dict(rows_of(awkward)), 0
    for r in sorted(got, key=lambda r: r["start"]):
        want = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids"] == want and r["start"] == start and r["ids_crc32"] == crc(want)
        start += len(want)
    assert simple8b.read_back(spark, simple8b.write(nothing, WORD_BPE, _store.shared(spark, "t"))).count() == 0


def test_simple8b_query(spark, tokenizer):
    got = {r["doc_id"]: r for r in queries.op2_simple8b(spark, SF).collect()}
    start = 0
    for doc_id, text in sorted(rows_of(spark.read.parquet(f"{SF}/documents.parquet"))):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


# packing


def check_packed(pieces, texts, tokenizer):
    """Pieces tile each document and each sequence; gives tokens and sequences."""
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in texts}
    rows = Counter(d for d, _ in texts)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["ids_crc32"] == crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) and p["doc_tokens"] == len(ids[p["doc_id"]]) and p["length"] > 0
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        cover = Counter(i for p in ps for i in range(p["start"], p["start"] + p["length"]))
        assert cover == Counter({i: rows[d] for i in range(len(ids[d]))})
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    return sum(len(x) * rows[d] for d, x in ids.items()), len(by_sequence)


def test_packing(spark, awkward, nothing, tokenizer):
    check_packed(packing.pack(awkward, WORD_BPE).collect(), rows_of(awkward), tokenizer)
    assert packing.pack(nothing, WORD_BPE).count() == 0
    tokens, sequences = check_packed(queries.op4_packing(spark, SF).collect(), rows_of(spark.read.parquet(f"{SF}/documents.parquet")), tokenizer)
    assert sequences * packing.CAPACITY < 1.04 * tokens + packing.CAPACITY


def test_few_documents_are_cut_and_little_is_padded(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), WORD_BPE).collect()
    pieces = Counter(r["doc_id"] for r in got)
    short = {r["doc_id"] for r in got if r["doc_tokens"] <= packing.CAPACITY}
    cut = sum(pieces[d] > 1 for d in short)
    padded = 1 - sum(r["length"] for r in got) / (packing.CAPACITY * len({r["sequence_id"] for r in got}))
    print(f"{cut} of {len(short)} cut, {padded:.4f} padded")
    assert cut < 0.15 * len(short) and padded < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_differencing(sizes):
    parts = packing.windows(np.array(sizes), 64)
    sums = Counter()
    covered = [Counter() for _ in sizes]
    for item, start, length, window in parts:
        assert length > 0
        sums[window] += length
        covered[item].update(range(start, start + length))
    assert max(sums.values()) <= 64 and len(sums) <= -(-sum(sizes) // 64)
    assert all(c == Counter(range(n)) for c, n in zip(covered, sizes))


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(5).integers(1, 100, 400)
    _, sums = packing.differencing(sizes, 20)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3


# fingerprints


def test_fingerprints(spark, awkward):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "d e f\na b c"), (3, "a b c"), (4, "d e f"), (5, "a b c\nd e f"), (6, None), (7, "")], "doc_id long, text string")
    fp = multiset.fingerprints(docs)
    got = {r["doc_id"]: r["fp"] for r in fp.withColumn("fp", multiset.as_string("fingerprint")).collect()}
    assert got[1] == got[5] == got[2] and got[6] == got[7] and len({got[1], got[3], got[4], got[6]}) == 4
    a, b, ab = (fp.where(f"doc_id = {i}").select(F.col("fingerprint").alias(n)) for i, n in ((3, "a"), (4, "b"), (1, "ab")))
    both = a.crossJoin(b).crossJoin(ab).select(multiset.add(F.col("a"), F.col("b")).alias("sum"), multiset.subtract(F.col("ab"), F.col("b")).alias("rest"), "a", "ab")
    r = both.first()
    assert r["sum"] == r["ab"] and r["rest"] == r["a"]


def test_edits(spark, awkward, nothing):
    for docs in (awkward.dropDuplicates(["doc_id"]), spark.read.parquet(f"{SF}/documents.parquet"), awkward.where("doc_id = 3")):
        texts = sorted(rows_of(docs), reverse=True)
        want = {}
        for i, (d, t) in enumerate(texts):
            n, after = len(t) // 3, texts[(i + 1) % len(texts)][1]
            want[d] = (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
        got = multiset.edited(docs).collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want and len(got) == len(texts)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert multiset.edited(nothing).count() == 0
    assert multiset.edited(awkward).count() == 17
    got = queries.op5_multiset_hash(spark, SF).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95


def test_likeness_of_a_long_line_with_a_word_more_or_less(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(x) for x in (w, ["new", *w], w[1:], w[:9] + ["new"] + w[9:], [f"v{i}" for i in range(400)])] + ["one  two", "one two", "three two"]
    fp = multiset.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a, b = fp.select(F.col("doc_id").alias("i"), F.col("fingerprint").alias("a")), fp.select(F.col("doc_id").alias("j"), F.col("fingerprint").alias("b"))
    near = {(r["i"], r["j"]): r["near"] for r in a.crossJoin(b).select("i", "j", multiset.likeness("a", "b").alias("near")).collect()}
    assert all(near[0, j] > 0.9 for j in (1, 2, 3)) and near[0, 4] < 0.1 and near[5, 6] == 1 and near[6, 7] < 0.7


def distinct_runs(text):
    out = set()
    for line in text.split("\n"):
        w = re.findall(r"[^ \t\n\x0b\f\r]+", line)
        if w:
            out |= {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)}
    return out


def run_count(text):
    n = [len(re.findall(r"[^ \t\n\x0b\f\r]+", line)) for line in text.split("\n")]
    return sum(max(1, k - 3) for k in n if k)


def jaccard(a, b):
    x, y = distinct_runs(a), distinct_runs(b)
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def test_likeness_is_the_share_of_common_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted(rows_of(docs), reverse=True)
    want = {}
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        want[d] = (jaccard(t, edited), jaccard(t, after), max(map(run_count, (t, edited))), max(map(run_count, (t, after))))
    exact_ones = 0
    got = multiset.edited(docs).collect()
    for r in got:
        e, a, n_e, n_a = want[r["doc_id"]]
        for near, exact, n in ((r["near_edited"], e, n_e), (r["near_next"], a, n_a)):
            if n <= multiset.SAMPLE:
                assert abs(near - exact) < 1e-9
                exact_ones += 1
    assert exact_ones > 500
    errors = [r["near_edited"] - want[r["doc_id"]][0] for r in got]
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.03


def test_long_fingerprints_add_and_subtract(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"w{i}" for i in rng.integers(0, 500, 60)) for _ in range(30)]
    docs = spark.createDataFrame([(1, "\n".join(lines[:20])), (2, "\n".join(lines[20:] + lines[:3])), (3, "\n".join(lines[20:] + lines[:3] + lines[:20]))], "doc_id long, text string")
    fp = multiset.fingerprints(docs)
    a, b, ab = (fp.where(f"doc_id = {i}").select(F.col("fingerprint").alias(n)) for i, n in ((1, "a"), (2, "b"), (3, "ab")))
    r = a.crossJoin(b).crossJoin(ab).select(multiset.add(F.col("a"), F.col("b")).alias("sum"), multiset.subtract(F.col("ab"), F.col("b")).alias("rest"), "a", "ab").first()
    assert r["sum"] == r["ab"] and r["ab"]["level"] > 0
    assert (r["rest"]["exact"], r["rest"]["n"]) == (r["a"]["exact"], r["a"]["n"])
    assert r["rest"]["runs"] == [x for x in r["a"]["runs"] if x % (1 << r["ab"]["level"]) == 0]


def test_hot_doc_ids_are_split(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i}") for i in range(900)] + [(7, "text number 0"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = multiset.in_order(docs.withColumn("text", F.coalesce("text", F.lit(""))), ["text"]).collect()
    key = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((d, t or "") for d, t in rows)
    assert Counter(r["next_text"] for r in got) == Counter(t or "" for _, t in rows)  # each is next once
    texts = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string")
    h = {r["t"]: r["h"] for r in texts.select("t", F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h")).collect()}
    order = sorted(got, key=lambda r: (*key(r), h[r["text"]], r["text"]))
    for r, after in zip(order, order[1:] + order[:1]):
        assert after["text"] in (r["next_text"], r["text"])


# byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(MULTI), special_tokens={})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30) | st.text(alphabet="ab 'st\n\t\xa0 é1", max_size=40), min_size=1, max_size=6))
def test_bpe_equals_the_library(reference_bpe, texts):
    own = bpe.coder(MULTI, public_tokenizers.PATTERN)
    for t, (n, ids, plain) in zip(texts, own.texts(pa.array(texts, pa.string()))):
        got = [int(x) for part in ids if part for x in part.split(",")]
        assert got == reference_bpe.encode_ordinary(t) and n == len(got) and b"".join(plain) == t.encode()
        assert own.decode([got]) == [t.encode()]


def test_bpe_query(spark, awkward, nothing, reference_bpe):
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = dict(rows_of(docs))
        got = bpe.encode(docs, MULTI, public_tokenizers.PATTERN).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = reference_bpe.encode_ordinary(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode(nothing, MULTI, public_tokenizers.PATTERN).count() == 0


def test_words_split_as_the_pattern_says():
    texts = ["a b\tc\x0bd\n\ne", "", "  é\x1cf\x85g ", "x"]
    buf, off = _text.as_bytes(pa.array(texts))
    ws, we, word_off = _text.words(buf, off)
    raw = buf.tobytes()
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(ws[word_off[i] : word_off[i + 1]], we[word_off[i] : word_off[i + 1]])] == words(t)


@pytest.mark.parametrize("size", [1_500, 20_000, 200_000])
@pytest.mark.parametrize("letters", ["a", "ab", "etaoinshrd", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "=-", " ", "日本語é"])
def test_bpe_of_long_matches(reference_bpe, letters, size):
    rng = np.random.default_rng(size)
    text = "".join(np.array(list(letters))[rng.integers(0, len(letters), size)])
    (got,) = bpe.coder(MULTI, public_tokenizers.PATTERN).encode_words([text.encode()])
    assert [int(x) for x in got[1].split(",")] == reference_bpe._encode_single_piece(text.encode()) and got[0] == got[1].count(",") + 1 and got[2] == text.encode()


def test_bpe_of_a_document_with_a_long_run(spark, reference_bpe):
    text = "before " + "".join(chr(97 + i * i % 23) for i in range(20_000)) + " after"
    (r,) = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MULTI, public_tokenizers.PATTERN).collect()
    ids = reference_bpe.encode_ordinary(text)
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# equality is by bytes, not by hashes


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def twins():
    """Pairs of unlike words that any polynomial hash modulo 2**64 takes for one."""
    return [(thue_morse(n, x), thue_morse(n, x[::-1])) for n in (1024, 2048, 4096) for x in ("ab", "{|", "é日")]


def test_words_of_one_hash_have_their_own_ids(spark, twins, tokenizer, reference_bpe):
    clash = 0
    for pair in twins:
        buf, off = _text.as_bytes(pa.array(pair))
        h = _text.hash_spans(buf, off[:-1], off[1:])
        clash += h[0] == h[1]
        assert _text.distinct_spans(buf, off[:-1], off[1:])[0].tolist() == [0, 1]
        for order in (pair, pair[::-1]):  # in one batch and one after the other
            for texts in ([*order, " ".join(order)], [order[0]], [order[1]]):
                ids, at = _tokens.WordCoder(WORD_BPE).encode(pa.array(texts))
                assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        coder = _tokens.WordCoder(WORD_BPE)
        for t in (*pair, *pair):
            assert coder.encode(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert clash
    rows = [t for pair in twins for t in (f"x {pair[0]} {pair[1]} y", *pair)]
    own = bpe.coder(MULTI, public_tokenizers.PATTERN)
    for t, (n, ids, plain) in zip(rows, own.texts(pa.array(rows))):
        got = [int(x) for part in ids if part for x in part.split(",")]
        assert got == reference_bpe.encode_ordinary(t) and b"".join(plain) == t.encode()
    for a, b in twins:
        texts = [f"{a}\n{b}\n{a}", f"{a} {a} {a}\n{b} {b} {b}", f"{a}\n{b}"]
        found = rules.measure(pa.array(texts))
        assert all({k: int(v[i]) for k, v in found.items()} == brute_measures(t) for i, t in enumerate(texts))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(rows)}
    got = simple8b.read_back(spark, simple8b.write(docs, WORD_BPE, _store.shared(spark, "t")), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: x + [2] for i, x in want.items()}
    check_packed(packing.pack(docs, WORD_BPE).collect(), list(enumerate(rows)), tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(x & 1 for x in b)), max_size=40))
def test_distinct_spans(spans):
    buf = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans]).astype(np.int64)
    starts = ends - np.array([len(s) for s in spans], np.int64)
    codes, first = _text.distinct_spans(buf, starts, ends, np.zeros(len(spans), np.uint64))  # all of one hash
    assert all((codes[i] == codes[j]) == (a == b) for i, a in enumerate(spans) for j, b in enumerate(spans))
    assert all(spans[f] == spans[i] for i, f in enumerate(first[codes].tolist()))
    runs = _text.gram_codes(codes, 3)
    assert all((runs[i] == runs[j]) == (spans[i : i + 3] == spans[j : j + 3]) for i in range(len(runs)) for j in range(len(runs)))


# memory


def test_long_texts_come_in_small_batches(spark):
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', 100 + id, ' '), 4000)").alias("text"))
    size = lambda column: {"size": np.full(len(column), column.buffers()[2].size)}
    most, total = _rows.with_measures(docs, size, ("size",)).agg(F.max("size"), F.sum(F.length("row.text"))).first()
    assert total == 600 * 20_000 and most < 4 << 20


def test_readers_hold_fewer_rows_unless_the_session_says(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(name)
    _rows.small_batches(spark.range(1))
    assert spark.conf.get(name) == "512"
    spark.conf.set(name, "1000")
    _rows.small_batches(spark.range(1))
    assert spark.conf.get(name) == "1000"
    spark.conf.unset(name)


def test_written_tables_have_small_row_groups(spark):
    long = spark.range(0, 3000, 1, 1).select("id", F.expr("concat_ws('', transform(sequence(1, 80), i -> sha2(concat(id, '.', i), 512)))").alias("text"))
    table = _store.written(long, "groups")
    groups = [g for f in ds.dataset(table.inputFiles()[0]).get_fragments() for g in f.row_groups]
    assert table.count() == 3000 and max(g.total_byte_size for g in groups) < 16 << 20
    _store.forget(table)


def test_results_are_written_in_small_row_groups_unless_the_session_says(spark, tmp_path):
    """A stage's rows are written by whoever takes them: with row groups of 128 MB a heap of 1 GB ends in an error."""
    long = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat_ws('', transform(sequence(1, 80), i -> sha2(concat(id, '.', i), 512)))").alias("text"))
    spark.conf.unset("parquet.block.size")
    _rows.keep_where(long, lambda column: np.ones(len(column), bool)).write.parquet(str(tmp_path / "kept"))
    groups = [g for f in ds.dataset(str(tmp_path / "kept")).get_fragments() for g in f.row_groups]
    assert sum(g.num_rows for g in groups) == 3000 and max(g.total_byte_size for g in groups) < 16 << 20
    spark.conf.set("parquet.block.size", "1000000")
    _rows.small_batches(long)
    assert spark.conf.get("parquet.block.size") == "1000000"
    spark.conf.unset("parquet.block.size")


def test_a_worker_forgets_words_when_another_stage_begins(monkeypatch):
    stage = [1]
    monkeypatch.setattr(_text, "_stage", lambda: stage[0])
    texts = pa.array(["one two", "three"])
    mine = _tokens.coder(WORD_BPE)
    list(_text.pieces(texts))
    assert _tokens.coder(WORD_BPE) is mine
    stage[0] = 2
    list(_text.pieces(texts))
    assert not _tokens._coders


def test_a_smaller_memory_of_words_gives_the_same_ids():
    texts = pa.array([" ".join(f"w{i * 37 % 900}x" for i in range(k, k + 300)) for k in range(0, 3000, 100)] + [None, "it's 日本"])
    small, large = _tokens.WordCoder(WORD_BPE, 700), _tokens.WordCoder(WORD_BPE)
    for a in range(0, len(texts), 4):
        (ids, off), (same, ends) = (c.encode(texts.slice(a, 4), 1) for c in (small, large))
        assert ids.tolist() == same.tolist() and off.tolist() == ends.tolist()
        assert small.count <= 700
    assert large.count > 700


def test_simple8b_remembers_more_words_than_the_default(monkeypatch, tokenizer):
    asked, make = [], _tokens.coder

    def noted(path, memory=_tokens.MEMORY):
        asked.append(make(path, memory))
        return asked[-1]

    class Rows:
        """Stands for the sorted rows: write() gets no further than one worker's pass over a batch."""

        sparkSession = None

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, f, schema):
            list(f(iter([])))
            return self

    monkeypatch.setattr(_tokens, "coder", noted)
    monkeypatch.setattr(_rows, "texts", lambda docs: docs)
    monkeypatch.setattr(_rows, "long_ids", lambda docs: None)
    monkeypatch.setattr(_store, "partitions", lambda spark: 1)
    monkeypatch.setattr(_store, "written", lambda df, name: df)
    monkeypatch.setattr(Rows, "collect", lambda self: [], raising=False)
    monkeypatch.setattr(simple8b.F, "spark_partition_id", Rows)
    assert simple8b.write(Rows(), WORD_BPE, "unused") == []
    (coder,) = asked
    coder.encode(pa.array(["alpha beta"]))
    coder.count = 1_200_000  # as after some 90 MB of texts
    coder.encode(pa.array(["gamma"]))
    assert coder.count == 1_200_001
    _tokens._forget_coders()
