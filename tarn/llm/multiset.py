"""Document fingerprints as homomorphic multiset hashes, by SQL functions alone.

A paragraph (a line) is hashed to a wide vector of eight 32-bit lanes, and a
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
2**32.  So paragraphs can be added or taken away without the rest of the text
(``add``, ``subtract``), their order does not count, and equal texts have equal
fingerprints.

For likeness a second vector is summed, sparse and with one coordinate for each
run of ``RUN_WORDS`` of a paragraph's words (one begins at every word; a shorter
paragraph is one run).  Of its 2**64 coordinates those are kept whose hash ends
in ``level`` zero bits, the level being the least at which ``SAMPLE`` runs are
expected at most; a run that occurs twice is listed twice, so this vector too
can be added and subtracted.  ``likeness`` is the share of the distinct runs of
two texts that both have (Jaccard), by the coordinates that both fingerprints
keep: exact for texts of up to ``SAMPLE`` runs, with a standard error of
sqrt(J (1 - J) / n), below 0.045, for longer ones, n >= SAMPLE / 2 being the
runs kept of the longer text if they are distinct.

A null text counts as empty; an empty text is one empty paragraph; documents of
equal doc_id are ordered by a hash of their text, then by text; a null doc_id
comes after all others; a lone document is its own next one; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import _rows, _store

#: Words of a paragraph that are hashed together for likeness.
RUN_WORDS = 4
#: Runs that a fingerprint is expected to keep at most.
SAMPLE = 256
SEEDS = (1, 2, 3, 4)
_LOW = 0xFFFFFFFF
#: SQL for the hashes of the runs of a line's word hashes w: one begins at each word that has enough after it.
_RUNS = f"""CASE WHEN size(w) = 0 THEN CAST(array() AS ARRAY<BIGINT>) WHEN size(w) < {RUN_WORDS} THEN array(xxhash64(w))
         ELSE transform(sequence(0, size(w) - {RUN_WORDS}), i -> xxhash64({", ".join(f"w[i + {k}]" for k in range(RUN_WORDS))})) END"""


def _level(n: str) -> str:
    """SQL for the level of a text of n runs."""
    return f"CAST(greatest(0, ceil(log2(greatest({n}, 1) / {SAMPLE}D))) AS INT)"


def _at_level(runs: str, level: str) -> str:
    """SQL for the runs that a level keeps."""
    return f"filter({runs}, x -> (x & (shiftleft(1L, {level}) - 1L)) = 0L)"


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column as a struct: exact (8 lanes), n (all runs), level, and runs (hashes kept, ascending).

    Lambda variables bind what is used more than once, so it is computed once.
    """
    whole = ", ".join(f"transform(paragraphs, p -> xxhash64({s}, p))" for s in SEEDS)
    return F.expr(f"""
        transform(array(coalesce({text}, '')), t ->
          transform(array(split(t, '\\n', -1)), paragraphs ->
            transform(array(flatten(transform(paragraphs, p ->
                transform(array(transform(regexp_extract_all(p, '\\\\S+', 0), x -> xxhash64(x))), w -> {_RUNS})[0]))), hs ->
              named_struct(
                'exact', flatten(transform(array({whole}), v -> array(
                   aggregate(v, 0L, (a, h) -> (a + (h & {_LOW}L)) & {_LOW}L),
                   aggregate(v, 0L, (a, h) -> (a + shiftrightunsigned(h, 32)) & {_LOW}L)))),
                'n', CAST(size(hs) AS BIGINT),
                'level', {_level("size(hs)")},
                'runs', sort_array({_at_level("hs", _level("size(hs)"))})
              ))[0])[0])[0]""")


def _lanes(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a["exact"], b["exact"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW).cast("long")))


def _kept(runs: Column, level: Column) -> Column:
    return F.filter(runs, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1) == 0)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of two documents' paragraphs together."""
    n = a["n"] + b["n"]
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / float(SAMPLE))), a["level"], b["level"]).cast("int")
    return F.struct(_lanes(a, b, 1).alias("exact"), n.alias("n"), level.alias("level"), F.sort_array(_kept(F.concat(a["runs"], b["runs"]), level)).alias("runs"))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a without b's paragraphs, which a must hold; its level stays that of a."""
    level = F.greatest(a["level"], b["level"])
    without = lambda held, x: F.concat(F.slice(held, F.lit(1), F.array_position(held, x).cast("int") - 1), F.slice(held, F.array_position(held, x).cast("int") + 1, F.size(held)))
    rest = F.aggregate(_kept(b["runs"], level), _kept(a["runs"], level), without)
    return F.struct(_lanes(a, b, -1).alias("exact"), (a["n"] - b["n"]).alias("n"), level.alias("level"), rest.alias("runs"))


def as_string(fp: str) -> Column:
    """A fingerprint column as lowercase hexadecimal digits: the lanes, the number of runs, and the SHA-256 of the runs kept."""
    return F.expr(f"""concat(
        array_join(transform({fp}.exact, x -> lpad(lower(hex(x)), 8, '0')), ''), lpad(lower(hex({fp}.n)), 16, '0'),
        sha2(CAST(array_join(transform({fp}.runs, x -> hex(x)), '') AS BINARY), 256))""")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of the distinct word runs of two texts that both have, by their fingerprints; 1 if these are equal."""
    return F.expr(f"""CASE WHEN {a} = {b} THEN 1.0D ELSE
        transform(array(greatest({a}.level, {b}.level)), level ->
          transform(array({_at_level(f"{a}.runs", "level")}), x -> transform(array({_at_level(f"{b}.runs", "level")}), y ->
            CASE WHEN size(x) + size(y) = 0 THEN 0.0D ELSE size(array_intersect(x, y)) / CAST(size(array_union(x, y)) AS DOUBLE) END)[0])[0])[0] END""")


def _below(edges: list, column: str) -> str:
    """SQL for how many of the ascending edges are below a column, by two short searches."""
    if not edges:
        return "0"
    step = math.isqrt(len(edges)) + 1
    coarse = "array(" + ", ".join(f"{e}L" for e in edges[step - 1 :: step]) + ")" if len(edges) >= step else "CAST(array() AS ARRAY<BIGINT>)"
    fine = "array(" + ", ".join("array(" + ", ".join(f"{e}L" for e in edges[i : i + step]) + ")" for i in range(0, len(edges), step)) + ")"
    return f"""transform(array(size(filter({coarse}, e -> e < {column}))), k ->
        k * {step} + coalesce(size(filter(get({fine}, k), e -> e < {column})), 0))[0]"""


def in_order(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """docs with next_<column>: the values of the next document by descending doc_id (after the last: the first).

    Ranges of about equal counts are windows of their own: of doc_ids, and of
    the texts' hashes for a doc_id (or none) that many documents have.  The first
    document of a range is also handed to the range before it.
    """
    parts = _store.partitions(docs.sparkSession)
    n = max(8 * min(parts, 1000), 2 * parts)
    docs = docs.withColumn("text_hash", F.shiftrightunsigned(F.xxhash64(text), 1))
    shares = "array(" + ", ".join(f"{i / n}D" for i in range(1, n)) + ")"
    found = docs.agg(F.expr(f"percentile_approx(CAST(doc_id AS BIGINT), {shares}, {max(10000, 4 * n)})").alias("e"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    # a doc_id that is the edge of several ranges has as many of its own; so have documents without one
    times = Counter(found["e"] or [])
    edges = sorted(times)
    without = max(1, round(n * (found["rows"] - found["ids"]) / max(1, found["rows"])))
    own = [times[e] if times[e] > 1 else 0 for e in edges]
    first = [without]
    for k in own:
        first.append(first[-1] + 1 + k)
    longs = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    part = lambda k: f"({k} - 1 - least({k} - 1, CAST(floor({k} * (text_hash / {float(1 << 63)!r}D)) AS BIGINT)))"
    places = f"""transform(array(CAST({_below(edges, "doc_id")} AS INT)), b -> transform(array(get({longs([*own, 0])}, b)), k ->
        get({longs(first)}, b) + CASE WHEN k > 1 AND doc_id = get({longs([*edges, 0])}, b) THEN 1 + {part("k")} ELSE 0 END)[0])[0]"""
    bucket = F.expr(f"CASE WHEN doc_id IS NULL THEN {part(f'{without}L')} ELSE {places} END").cast("int")
    placed = docs.withColumn("bucket", bucket)
    # one row per range: their number depends on the partitions, not on the documents
    top = F.max(F.struct("doc_id", F.bitwise_not("text_hash").alias("h")))
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(top.alias("head")).collect()}
    if not heads:
        return placed.select(*docs.columns, *(F.col(c).alias(f"next_{c}") for c in columns)).drop("text_hash")
    present = sorted(heads)
    goes = {b: present[(i + 1) % len(present)] for i, b in enumerate(present)}
    size = present[-1] + 1
    id_of = lambda b: heads[b]["doc_id"] if b in heads else None
    head = F.expr("array(" + ", ".join(f"{id_of(b)}L" if id_of(b) is not None else "CAST(NULL AS BIGINT)" for b in range(size)) + ")")
    hashes = F.expr(longs(~heads[b]["h"] if b in heads else -1 for b in range(size)))
    to = F.expr("array(" + ", ".join(str(goes.get(b, 0)) for b in range(size)) + ")")
    at = F.col("bucket")
    own_place = F.struct(at.alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(to, at).alias("bucket"), F.lit(1).alias("guest"))
    is_head = F.col("doc_id").eqNullSafe(F.get(head, at)) & (F.col("text_hash") == F.get(hashes, at))
    copies = F.when(is_head, F.array(own_place, guest)).otherwise(F.array(own_place))
    rows = placed.select(*docs.columns, F.explode(copies).alias("place")).select(*docs.columns, "place.bucket", "place.guest")
    window = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_hash", text)
    return rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("guest = 0").drop("bucket", "guest", "text_hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (a struct) of every document."""
    return _rows.texts(docs).select("doc_id", fingerprint("text").alias("fingerprint"))


def edited(docs: DataFrame) -> DataFrame:
    """Every document with the fingerprints of its text, its edited text and the next text, and their likeness."""
    rows = _rows.texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_order(rows.withColumn("fp", fingerprint("text")), ["text", "fp"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", fingerprint("edited").alias("efp"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
