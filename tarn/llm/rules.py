"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements
and one failure bit per rule.  Policies are versioned masks over those bits:
``verdicts`` applies one, ``ablations`` tells by bitwise aggregation what each
rule of a policy removes alone and what would come back without it.  Neither
reads the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as empty, an empty text
has no words and fails ``few_words``; repeated rows give repeated rows; an
empty table gives an empty ledger; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _rows, _text

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper")

#: Rule -> failure, as SQL over the measurements; a rule's bit is its place.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "bangs": "5 * n_bangs > n_words",
    "capitals": "100 * n_upper > 30 * word_chars",
    "word_length": "10 * word_chars < 25 * n_words OR word_chars > 12 * n_words",
    "repeated_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
}
BASE = ("few_words", "repeated_words")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)


POLICIES = {1: Policy(1, BASE), 2: Policy(2, tuple(RULES))}
CURRENT = POLICIES[2]


def _count(buf: np.ndarray, off: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return _text.counts_in(table[buf], off)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a column, one array for each of MEASURES."""
    buf, off = _text.as_bytes(column)
    n = len(off) - 1
    ws, we, word_off = _text.words(buf, off)
    out = {"n_words": np.diff(word_off)}
    char = ((buf & 0xC0) != 0x80) & ~_text.IS_SPACE[buf]
    out["word_chars"] = _text.counts_in(char, off)
    out["n_symbols"] = _count(buf, off, SYMBOLS)
    out["n_bangs"] = _count(buf, off, "!")
    out["n_upper"] = _count(buf, off, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    newline = buf == 0x0A
    breaks = np.flatnonzero(newline)
    line_starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf))[: len(line_starts)]
    line_ends = np.where((line_ends > line_starts) & newline[line_ends - 1], line_ends - 1, line_ends)
    has_word = np.searchsorted(ws, line_ends) > np.searchsorted(ws, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(off, line_starts, side="right") - 1
    lines, _ = _text.distinct_spans(buf, line_starts, line_ends)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[_text.seen_before(lines, line_doc)], minlength=n)

    inside, doc = _text.gram_owner(word_off, 3)
    at = np.flatnonzero(inside)
    runs = _text.gram_codes(_text.distinct_spans(buf, ws, we)[0], 3)[at]
    twice = pd.Series(doc[at] * (int(runs.max(initial=0)) + 1) + runs).duplicated(keep=False).to_numpy()
    hit = at[twice]
    covered = np.zeros(len(ws), bool)
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = _text.counts_in(covered, word_off)
    return {k: np.asarray(out[k], np.int64) for k in MEASURES}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for a, b in _text.pieces(text):
            found = measure(text.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(found[k]) for k in MEASURES)], ["doc_id", *MEASURES])


def failures() -> F.Column:
    """The failure bits of a row that has the measurements."""
    out = F.lit(0).cast("long")
    for rule, failed in RULES.items():
        out = out.bitwiseOR(F.when(F.expr(failed), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits of every document."""
    rows = _rows.texts(docs).mapInArrow(_measured, f"doc_id {_rows.id_type(docs)}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failed_bits", failures())


def verdicts(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    base = sum(bit(r) for r in BASE)
    return entries.withColumns({"base_failed": hit(base), "kept": ~hit(base | policy.mask), "policy_version": F.lit(policy.version)})


def ablations(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and are kept without it.

    The documents are first counted by their bits, so at most 2**rules rows meet.
    """
    counted = entries.select(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in policy.rules))
    rows = counted.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    entries = _rows.with_measures(docs, measure, MEASURES)
    hit = failures().bitwiseAND(F.lit(policy.mask | sum(bit(r) for r in BASE)).cast("long"))
    return entries.where(hit == 0).select("row.*")
