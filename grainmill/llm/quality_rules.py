"""Repetition rules on single documents: coverage by duplicated n-grams and lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.text import IS_CONTINUATION, Chunk, chunks, mix, sums_by_document

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

#: n-gram lengths in words, with the largest share of a document's word
#: characters that may lie inside n-grams of that length found more than once.
COVERAGE_LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "dup_line_chars:bigint,dup_chars:array<bigint>,base_failed:boolean,kept:boolean>"
)


@dataclass(frozen=True)
class RepetitionRules:
    """Limits; a share is of a document's word characters.

    ``base_ngram`` words make a window of the base rule, which fails a document
    of fewer than ``least_words`` words or with over ``base_percent`` per cent
    of its words in windows that the document holds more than once.
    """

    coverage: tuple[tuple[int, float], ...] = tuple(COVERAGE_LIMITS.items())
    dup_line_share: float = 0.30
    base_ngram: int = 5
    base_percent: int = 20
    least_words: int = 10


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the values found twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][equal]] = True
    flags[order[:-1][equal]] = True
    return flags


def _covered(word_hash: np.ndarray, word_doc: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words inside a window of n words that its document holds more than once."""
    count = len(word_hash) - n + 1
    if count < 2:
        return np.zeros(len(word_hash), bool)
    with np.errstate(over="ignore"):
        rolled = np.zeros(count, np.uint64)
        for i in range(n):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + word_hash[i : i + count]
        keys = mix(rolled ^ mix(word_doc[:count].astype(np.uint64) + np.uint64(n)))
    whole = np.flatnonzero(word_doc[:count] == word_doc[n - 1 :])
    hits = whole[_repeated(keys[whole])]
    edge = np.zeros(len(word_hash) + 1, np.int32)
    edge[hits] += 1
    edge[hits + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(chunk: Chunk, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The measures of every document of a chunk."""
    hashed = chunk.hasher()
    starts, ends = chunk.words()
    char_ends = np.concatenate([[0], np.cumsum(~IS_CONTINUATION[chunk.data])])
    word_hash, word_chars = hashed(starts, ends), char_ends[ends] - char_ends[starts]
    per_word = lambda values: sums_by_document(values, starts, chunk)
    n_words = chunk.spans_per_document(starts)
    word_doc = np.repeat(np.arange(chunk.n), n_words)
    lengths = sorted({rules.base_ngram, *(n for n, _ in rules.coverage)})
    inside = {n: _covered(word_hash, word_doc, n) for n in lengths}

    line_starts, line_ends = chunk.lines()
    word_before = np.searchsorted(starts, line_starts)
    has_word = np.searchsorted(starts, line_ends) > word_before
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = chunk.document_of(line_starts)
    with np.errstate(over="ignore"):
        key = mix(hashed(line_starts, line_ends) ^ mix(line_doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    word_total = np.concatenate([[0], np.cumsum(word_chars)])
    line_chars = word_total[np.searchsorted(starts, line_ends)] - word_total[np.searchsorted(starts, line_starts)]

    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[chunk.data])])
    return {
        "n_words": n_words,
        "word_chars": per_word(word_chars),
        "n_symbols": symbols[chunk.offsets[1:]] - symbols[chunk.offsets[:-1]],
        "n_dup_lines": np.bincount(line_doc[later], minlength=chunk.n),
        "n_repeat_words": per_word(inside[rules.base_ngram]),
        "dup_line_chars": np.bincount(line_doc[later], line_chars[later], minlength=chunk.n).astype(np.int64),
    } | {f"dup_{n}": per_word(inside[n] * word_chars) for n, _ in rules.coverage}


def repetition_measures(text: Column, rules: RepetitionRules = RepetitionRules()) -> Column:
    """A struct of repetition measures and verdicts of one text column."""

    @F.arrow_udf(RESULT)
    def measured(texts: pa.Array) -> pa.Array:
        parts = [measure(chunk, rules) for chunk in chunks(texts)]
        parts = parts or [measure(Chunk(np.empty(0, np.uint8), np.zeros(1, np.int64)), rules)]
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        base_failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.base_percent * m["n_words"])
        within = m["dup_line_chars"] <= rules.dup_line_share * m["word_chars"]
        for n, share in rules.coverage:
            within &= m[f"dup_{n}"] <= share * m["word_chars"]
        covers = np.stack([m[f"dup_{n}"] for n, _ in rules.coverage], axis=1).astype(np.int64)
        offsets = np.arange(len(covers) + 1, dtype=np.int32) * covers.shape[1]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
        columns = [pa.array(m[k].astype(np.int64)) for k in names]
        columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(covers.ravel())), pa.array(base_failed), pa.array(~base_failed & within)]
        return pa.StructArray.from_arrays(columns, [*names, "dup_chars", "base_failed", "kept"])

    return measured(text)


def with_repetition_rules(docs: DataFrame, text: str = "text", out: str = "rules", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Every row with a struct column ``out`` of measures and the verdict ``kept``.

    One pass, no shuffle: rolling hashes over numpy arrays of whole texts find
    the n-grams and lines that a text holds more than once, and the characters
    inside them are counted.  ``dup_chars`` follows the order of
    ``rules.coverage``.  A document is kept if it passes the base rule and every
    share of covered characters is within its limit.

    A null text counts as empty; an empty text has no word and fails the base
    rule.  Rows are judged one by one, so repeated rows get equal results and an
    empty table stays empty.  A column of the input named as ``out`` is replaced;
    other columns pass through whatever their names.
    """
    return docs.withColumn(out, repetition_measures(F.col(f"`{text}`"), rules))
