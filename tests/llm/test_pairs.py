import base64
import hashlib
import html as entities
import random
import re
import time
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import _components, _store, _text, forest, html, queries, suffix, warc

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# components


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in _components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in up if root(n) != n}
    assert _components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# near duplicates


def brute_classes(rows, threshold=forest.THRESHOLD):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(n, seed, size=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, broadcast_rows", [(400_000, 1_000_000), (700, 1_000_000), (700, 0)])
def test_classes_of_groups(spark, block, broadcast_rows):
    texts = near_copies(40, 1) + near_copies(25, 2) + [f"alone {i} " * 3 for i in range(10)] + ["", None, "a b", "a b", "a  b"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, rep int, key string").repartition(3)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in forest.classes(docs, block=block, texts=16, broadcast_rows=broadcast_rows).collect())
    assert got == brute_classes(rows)


def test_classes_of_awkward_documents(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.classes(awkward).collect()}
    want = {d: (c, n) for d, c, n in brute_classes(rows)}
    assert got == want
    assert forest.classes(nothing).count() == 0
    kept = forest.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in want.values()})
    assert sorted(r["doc_id"] for r in forest.keep_first(awkward, broadcast_rows=0).collect()) == sorted(r["doc_id"] for r in kept.collect())
    assert forest.keep_first(nothing).count() == 0


def exact_pairs(rows, threshold=forest.THRESHOLD):
    """Pairs of unlike word sequences as similar as the threshold, by an inverted index of runs."""
    sets = list({frozenset(g) for g in (gram_set(t) for t in {tuple(words(t)) for _, t in rows} if t)})
    places = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            places[g].append(i)
    common = Counter((a, b) for at in places.values() for k, a in enumerate(at) for b in at[:k])
    return sum(c >= threshold * (len(sets[a]) + len(sets[b]) - c) for (a, b), c in common.items())


def gram_set(w):
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w}


def near_at(n, seed, size, edits):
    """Pairs of texts of so many words, one with some words replaced far apart."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"p{k}w{rng.randrange(10**6)}" for _ in range(size)]
        v = list(w)
        for e in range(edits):
            v[5 + e * 10] = f"x{rng.randrange(10**9)}"
        out += [" ".join(w), " ".join(v)]
    return out


def test_prefixes_are_shortened_to_the_recall(spark):
    # 104 runs of which 10 differ: 0.808; nearly the same texts need no short prefix
    for texts, shorter in ((near_at(300, 3, 108, 2), True), (near_at(300, 4, 1000, 1), False)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        reps = forest.representatives(_store.written(forest.sketch(docs), "t"))
        linked, d, share = forest.links(docs, reps)
        assert (d < forest.DEPTH) == shorter and share >= forest.RECALL
        assert linked.agg(F.sum("pairs")).first()[0] >= 298
        _, d, share = forest.links(docs, reps, recall=0.5)
        assert d == forest.DEPTH and share >= 0.5


def test_recall_at_the_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = exact_pairs([(r["doc_id"], r["text"]) for r in docs.collect()])
    reps = forest.representatives(_store.written(forest.sketch(docs), "t"))
    linked, d, share = forest.links(docs, reps)
    got = linked.agg(F.sum("pairs")).first()[0]
    print(f"{got} of {want} pairs, prefix {d}, expected share {share:.5f}")
    assert 0.98 * want <= got <= want


def test_only_pairs_of_a_prefix_are_compared_and_each_once(spark):
    texts = near_copies(60, 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = forest.representatives(_store.written(forest.sketch(docs), "t"))
    linked, _, _ = forest.links(docs, reps, block=1000, texts=8)
    assert linked.agg(F.sum("pairs")).first()[0] == exact_pairs(list(enumerate(texts)))


def test_doc_ids_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integer"):
        forest.classes(docs)


# repeated passages


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join(f"s{rng.randrange(3000)}" for _ in range(n))


def brute_spans(rows, size=suffix.PASSAGE):
    seen = defaultdict(list)
    for d, t in sorted(set((d, t or "") for d, t in rows)):
        w = words(t)
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].append((d, i))
    starts = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(sorted(places)):
                starts[d, k == 0].add(i)
    out = set()
    for (d, first), at in starts.items():
        at = sorted(at)
        begin = last = at[0]
        for i in at[1:] + [None]:
            if i is None or i - last > size:
                out.add((d, begin, last + size, first))
                begin = i
            last = i
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 49, 90, 200)]
    out = []
    for _ in range(40):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += [word() for _ in range(rng.randrange(60))] + rng.choice(passages)[: rng.choice([None, None, 55])]
        out.append(" ".join(w))
    return out + ["same " * 120, "same " * 150, "p q " * 70, "q p " * 80, "a b c d e f g h i j k l m n o p q r s t " * 12, "x " * 3 + "same " * 90 + "y " * 60, "", None, out[0], out[1] + " more"]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, seed):
    rows = list(enumerate(repeated_texts(seed)))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pos int, key int").repartition(3)
    got = [tuple(r) for r in suffix.spans(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)


def test_spans_of_awkward_documents(awkward, nothing):
    assert {tuple(r) for r in suffix.spans(awkward).collect()} == brute_spans([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert suffix.spans(nothing).count() == 0 and suffix.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [12 << 20, -1])
def test_removal(spark, broadcast_bytes):
    rows = list(enumerate(repeated_texts(3)))
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, of string")
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs, broadcast_bytes).collect()}
    gone = defaultdict(set)
    for d, a, b, first in brute_spans(rows):
        if not first:
            gone[d] |= set(range(a, b))
    assert len(got) == len(rows)
    for d, t in rows:
        assert words(got[d]["text"]) == [w for i, w in enumerate(words(t)) if i not in gone[d]]
        if d not in gone:
            assert got[d]["text"] == t
        assert got[d]["n_chars"] == len(got[d]["text"] or "")


# pages


def expected(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside)))
    return " ".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: expected(r["html"]) for r in pages.collect()}
    got = queries.op8_tag_paths(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<article><p>Short.</article>", "Short."),
        ("<body><div class='side-bar sidebar'><p>Ads, many.</p></div><div><h2>T</h2><p>A long text, with marks.</p><p>And <i>mo</i>re&nbsp;of it.</p></div><div id=comments><p>Nice, thanks!</p></div><footer>end</footer>", "T A long text, with marks. And more of it."),
        ("<main><h1>T</h1><table><tr><td>a<td>b</table><ul><li>one<li>two</ul><pre>x\n y</pre><script>if(a<b){}</script>5 < 6</main>", "T a b one two x y 5 < 6"),
        ("<article><p>a <!-- <p>no</p> --> b<style>p{}</style><form><label>Mail</label><input></form><aside>no</aside></article>", "a b"),
        ('<article><a href="x>y</a> text</article>', "y text"),
    ],
)
def test_pages(page, want):
    assert html.content(page) == want


@pytest.mark.parametrize("wrapper", ["form", "div class='page has-sidebar'", "div id=content-with-sidebar", "div class=no-comments"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_of_whole_pages(wrapper, inner):
    page = f"<body><{wrapper}><{inner}><h1>T</h1><p>A long text, with marks.</p></{inner}><div id=comments><p>Nice, thanks!</p><p>{'More of it, too. ' * 9}</p></div></{wrapper.split()[0]}></body>"
    assert html.content(page) == "T A long text, with marks."
    assert html.content(f"<form><div class='page has-sidebar'>{page}</div></form>") == "T A long text, with marks."


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "<article>x</article>", "t"), (2, "u", "<article>x</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html.extract(pages).collect()) == [(1, "", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


# archives


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=12), st.integers(1, 400), st.integers(1, 64))
def test_ranges_own_each_record_once(payloads, split, fetch):
    path = f"/tmp/tarn-test-{uuid.uuid4().hex}.warc.gz"
    noise = b"\x1f\x8b\x08junk\x1f\x8b\x08\x00"
    data = b"".join(warc.record(i, "http://a/", p + noise, None) for i, p in enumerate(payloads))
    with open(path, "wb") as f:
        f.write(data)
    got = [warc.parse(raw) for a in range(0, len(data), split) for _, raw in warc.members(path, a, min(a + split, len(data)), fetch)]
    _store.drop(path)
    assert [warc.page_of(x["fields"]["warc-record-id"]) for x in got] == list(range(len(payloads)))
    assert [x["payload"] for x in got] == [p + noise for p in payloads]


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, least):
    rows = [(5, "u", "abcdef"), (3, "u", "abcdef"), (9, None, "abcdef"), (1, "u", None), (2, "u", ""), (-4, "u", "é" * 5000), (7, "ü\r\nx", "abc"), (8, "u", "abc"), (6, "u", "x<p>" * 40000)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, sha string, first int")
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and first[h or ""] != i
        want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    manifest = warc.write(pages, _store.shared(spark, "t"), least)
    for split in (64, 1 << 20):
        got = warc.read(manifest, split, with_payload=True).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(rows)
        texts = {i: (h or "").encode() for i, _, h in rows}
        assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in got if r["record_type"] == "response")
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_a_damaged_payload_is_noticed():
    raw = bytearray(zlib.decompress(warc.record(1, "u", b"payload", None), 31))
    raw[raw.rindex(b"payload")] ^= 1
    with pytest.raises(ValueError, match="digest"):
        warc.parse(bytes(raw))


# pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = _store.written(stage(spark, before, SF), "t")
        if name != "packing":
            assert after.columns == docs.columns and 0 < after.count() <= before.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {c for _, c, _ in brute_classes(rows)}
        if name == "repeated_passages":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            gone = defaultdict(set)
            for d, a, b, first in brute_spans(rows):
                if not first:
                    gone[d] |= set(range(a, b))
            texts = dict(rows)
            assert all(words(r["text"]) == [w for i, w in enumerate(words(texts[r["doc_id"]])) if i not in gone[r["doc_id"]]] for r in after.collect())
        last, before = before, after
    assert {r["doc_id"] for r in before.select("doc_id").distinct().collect()} == {r["doc_id"] for r in last.collect()}


def test_pipeline_takes_more_columns_and_no_rows(spark, awkward, nothing):
    docs = awkward.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert name == "packing" or out.columns == docs.columns
            out.count()


def test_common_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    first, second = np.array([0, 2, 4]), np.array([1, 2, 8])
    got = forest._common(sets, first, second)
    assert all(got[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(first) for j, b in enumerate(second))


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_spans_of_hot_runs(spark, hot):
    rows = list(enumerate(repeated_texts(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffix.spans(docs, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)


def test_spans_by_words_and_not_by_hashes(spark, monkeypatch):
    # a hash that takes all words of one length for one, so runs and minimisers meet that share no words
    rows = list(enumerate(repeated_texts(6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = [t or "" for _, t in rows]
    monkeypatch.setattr(_text, "hash_spans", lambda buf, s, e: _text.mix64((e - s).astype(np.uint64)))
    column = pa.array(texts)
    found = suffix.Suffixes(column)
    found.spell()
    after = found.words(found.at, np.minimum(found.at + suffix.PASSAGE, found.word_off[found.owner + 1]))
    before = found.words(np.maximum(found.at - suffix.SIDE, found.word_off[found.owner]), found.at)
    order = sorted(range(len(after)), key=lambda i: (int(found.key[i]), after[i]))
    take = lambda x: np.asarray(x)[order]
    owner, pos = take(found.owner), take(found.pos)
    r, kind, lo, hi = suffix.matches(owner, owner * 0, pos, take(found.least), take(found.most), np.zeros(len(order), bool), pa.array([before[i] for i in order], pa.binary()), pa.array([after[i] for i in order], pa.binary()))
    got = defaultdict(set)
    for i, k, a, b in zip(r.tolist(), kind.tolist(), lo.tolist(), hi.tolist()):
        got[int(owner[i]), k == suffix.FIRST] |= set(range(a, b + 1))
    want = defaultdict(set)
    places = defaultdict(list)
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - suffix.PASSAGE + 1):
            places[tuple(w[i : i + suffix.PASSAGE])].append((d, i))
    for at in places.values():
        for k, (d, i) in enumerate(at if len(at) > 1 else []):
            want[d, k == 0].add(i)
    assert got == want


def test_a_passage_without_copies_in_its_task(spark):
    a = sentence(51, 200)
    docs = spark.createDataFrame([(1, a), (2, "x " + a)], "doc_id long, text string").repartition(2, "doc_id")
    assert {tuple(r) for r in suffix.spans(docs).collect()} == {(1, 0, 200, True), (2, 1, 201, False)}


def test_copies_and_what_they_share_with_others(spark):
    a, b, c = sentence(31, 120), sentence(32, 90), sentence(33, 70)
    rows = [(5, a), (3, a), (9, a), (4, f"{c} {a} {c}"), (1, b), (7, b), (2, " ".join(a.split()[20:90])), (8, c), (6, "short text"), (10, "short text"), (11, a), (11, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffix.spans(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)


def test_cuts_go_by_text_where_doc_ids_repeat(spark):
    a, b = sentence(41, 80), sentence(42, 80)
    rows = [(1, a), (2, f"x {a}"), (2, f"{b} y"), (None, f"{a} z"), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in suffix.remove_repeats(docs).collect())
    assert got == Counter([(1, a), (2, "x "), (2, f"{b} y"), (None, "z"), (None, "")])


def test_rows_without_doc_id_and_doc_ids_of_two_texts(spark):
    a = near_copies(1, 8)[0]
    b, c = a + " tail", a + " end"
    rows = [(None, a), (None, "other words of this row here"), (4, b), (4, "quite another text under the same number"), (2, c), (2, c), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in forest.classes(docs).collect())
    assert got == Counter([(None, 2, 3), (4, 2, 3), (2, 2, 3), (2, 2, 3), (None, None, 0), (4, 4, 0), (None, None, 0)])
    assert Counter(tuple(r) for r in forest.keep_first(docs).collect()) == Counter([(None, "other words of this row here"), (None, None), (4, "quite another text under the same number"), (2, c)])
    none = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert forest.keep_first(none).count() == 1
    big = spark.createDataFrame([(None, "p " + a), (1, a), (None, "p " + a)], "doc_id long, text string")
    assert {tuple(r) for r in suffix.spans(big).collect()} == {(1, 0, 120, True), (None, 1, 121, False)}
    assert suffix.remove_repeats(big).count() == 3


# tag-path ratios


def test_ratios_decide_without_article_tags_and_names(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert all(html.content(q) == expected(p) for p, q in zip(pages, plain))
    bare = [re.sub(r' class="[^"]*"', "", p) for p in plain]
    assert np.mean([html.content(q) == expected(p) for p, q in zip(pages, bare)]) > 0.7
    loose = [re.sub(r"</?article>", "", p) for p in pages]
    assert all(html.content(q) == expected(p) for p, q in zip(pages, loose))


def test_the_threshold_moves_the_text():
    page = "<body><div>Short note, here.</div><div><h2>Title</h2><p>" + "Some long text, with marks, and more. " * 9 + "</p><p>More of it, and on.</p></div></body>"
    some, all_, none = (html.content(page, t) for t in (html.THRESHOLD, 0, 1e9))
    assert some.startswith("Title Some") and some.endswith("and on.") and all_ == "Short note, here. " + some and none == ""


@pytest.mark.parametrize("name", ["content has-sidebar", "post tags-news", "no-comments page"])
def test_names_around_a_whole_article(spark, name):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = expected(r["html"])
        assert html.content(r["html"].replace("<body>", f'<body><div class="{name}">')) == want
        if len(want) > 400:
            assert html.content(r["html"].replace("<article>", f'<div class="{name}">').replace("</article>", "</div>")) == want


@pytest.mark.parametrize("where", ["</article>", "<article>", "<body>"])
def test_comments_and_sidebars(spark, where):
    more = "".join(f"<{tag} class='{name}'><h3>More</h3><p>{'Nice words, really nice words. ' * 40}</p></{tag}>" for tag, name in (("section", "comments"), ("div", "sidebar"), ("div", "related-posts")))
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = r["html"].replace(where, more + where if where == "</article>" else where + more)
        assert html.content(page) == expected(r["html"])


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>x", "<b>", "<li>x", "<b><h1>", "<i></p>", '<x y="', "&amp;<", "<form>x", "<!", "</"])
@pytest.mark.parametrize("end", ["", ">\"'>"])
def test_long_pages_take_time_in_proportion(part, end):
    began = time.process_time()
    html.content(part * 40_000 + end)
    assert time.process_time() - began < 10  # quadratic: minutes
