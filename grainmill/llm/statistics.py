"""Statistics of single documents that a quality model reads, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.llm.text import IS_CONTINUATION, NEWLINE, Chunk, chunks, mix, sums_by_document

NAMES = (
    "log_words", "mean_word_chars", "sd_word_chars", "upper_share", "digit_share", "comma_stop_share", "symbol_words", "pipe_words",
    "exclaimed_words", "capital_words", "log_words_a_line", "dup_line_share", "repeat_word_share", "same_as_before", "new_word_share", "other_share",
)


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
_STOP, _SYMBOL, _PIPE, _EXCLAIM = _table(b".,;:?'\"()-"), _table(b"#*$%&<>@^~=+_{}[]\\/"), _table(b"|"), _table(b"!")
_WIDE = _table(bytes(range(0x80, 256)))
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _STOP | _SYMBOL | _PIPE | _EXCLAIM | _WIDE | _table(b" \t\n\x0b\x0c\r"))


def _flag_words(table: np.ndarray, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[chunk.data])])
    return total[ends] - total[starts]


def document_statistics(chunk: Chunk) -> np.ndarray:
    """Documents x NAMES.  Shares are on a square-root scale and counts on a log scale, nearer to normal than the raw ones."""
    starts, ends = chunk.words()
    n = chunk.spans_per_document(starts)
    some = np.maximum(n, 1)
    per = lambda v: sums_by_document(v.astype(float), starts, chunk)
    chars = np.concatenate([[0], np.cumsum(~IS_CONTINUATION[chunk.data])])
    length = chars[ends] - chars[starts]
    mean = per(length) / some
    spread = np.sqrt(np.maximum(per(length**2) / some - mean**2, 0))
    size = np.maximum(per(length), 1)
    share = lambda table: np.sqrt(per(_flag_words(table, chunk, starts, ends)) / size)
    has = lambda table: per(_flag_words(table, chunk, starts, ends) > 0) / some
    hashed = chunk.hasher()
    hashes, doc = hashed(starts, ends), np.repeat(np.arange(chunk.n), n)
    with np.errstate(over="ignore"):
        keys = mix(hashes ^ mix(doc.astype(np.uint64)))
    unique, first = np.unique(keys, return_index=True)
    new = np.zeros(len(keys), bool)
    new[first] = True
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    pair = keys.copy()
    with np.errstate(over="ignore"):
        for step in range(1, 4):
            pair[: len(keys) - step] = mix(pair[: len(keys) - step] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[step:])
    whole = np.zeros(len(keys), bool)
    if len(keys) > 3:
        whole[:-3] = doc[:-3] == doc[3:]
    at = np.flatnonzero(whole)
    order = at[np.argsort(pair[at], kind="stable")]
    repeat = np.zeros(len(keys), bool)
    repeat[order[1:][pair[order[1:]] == pair[order[:-1]]]] = True
    line_starts, line_ends = chunk.lines()
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = chunk.document_of(line_starts)
    with np.errstate(over="ignore"):
        line_key = mix(hashed(line_starts, line_ends) ^ mix(line_doc.astype(np.uint64)))
    _, line_first = np.unique(line_key, return_index=True)
    lines = np.bincount(line_doc, minlength=chunk.n)
    distinct = np.bincount(line_doc[line_first], minlength=chunk.n)
    capital = (_flag_words(_UPPER, chunk, starts, ends) > 0) & (_flag_words(_LOWER, chunk, starts, ends) == 0) & (length > 1)
    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), share(_UPPER), share(_DIGIT), share(_STOP), np.sqrt(has(_SYMBOL)), np.sqrt(has(_PIPE)),
        np.sqrt(has(_EXCLAIM)), np.sqrt(per(capital) / some), np.log1p(n / np.maximum(lines, 1)), np.sqrt(1 - distinct / np.maximum(lines, 1)) * (lines > 0),
        np.sqrt(per(repeat) / some), np.sqrt(per(same) / some), per(new) / some, share(_OTHER),
    ], axis=1)


def statistics(text: Column) -> Column:
    """The statistics of a text column as an array of doubles in the order of NAMES (null: as empty)."""

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = np.concatenate([document_statistics(c) for c in chunks(texts)] or [np.empty((0, len(NAMES)))])
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    return measured(text)
