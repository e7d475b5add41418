"""Vectorised views of Arrow text columns and helpers shared by the operators.

White space is the ASCII set ``[\\x20\\x09-\\x0D]`` everywhere.  All of it is
one byte long and no byte of a multi-byte UTF-8 character falls in that range,
so words and lines can be found on the raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from grainmill.plans.lineage import bucketed, written  # noqa: F401  for the operators

SPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
IS_CONTINUATION = np.zeros(256, bool)
IS_CONTINUATION[0x80:0xC0] = True
NEWLINE = 10

#: Bytes of text that are laid out as numpy arrays at a time.
CHUNK_BYTES = 1 << 19

#: Span hashes are two polynomials modulo this prime, each with its own base and byte codes drawn once.
PRIME = (1 << 31) - 1
_BITS, _PRIME = np.uint64(31), np.uint64(PRIME)
_random = np.random.default_rng(20240229)
_BASES = tuple(int(b) for b in _random.integers(1 << 20, PRIME, 2))
_BYTE_CODES = _random.integers(1, PRIME, (2, 256), dtype=np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    """Smaller numbers with the same remainders; below 2**32 for values below 2**62."""
    return (x & _PRIME) + (x >> _BITS)


def _remainder(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


class _Powers:
    """Powers of a base modulo the prime, as many as the longest array so far asked for."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint32)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), PRIME))
            self.table = np.concatenate([self.table, _remainder(self.table * step).astype(np.uint32)])
        return self.table


_powers = [_Powers(b) for b in _BASES]
_inverse_powers = [_Powers(pow(b, -1, PRIME)) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Consecutive documents as one byte array: document ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of set flags; no run crosses a document."""
        if not len(inside):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        before = np.empty(len(inside), bool)
        before[0] = False
        before[1:] = inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[heads] = False
        after = np.empty(len(inside), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        tails = self.offsets[1:] - 1
        after[tails[tails >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces between line feeds, one empty piece for an empty document."""
        feeds = np.flatnonzero(self.data == NEWLINE)
        starts = np.concatenate([self.offsets[:-1], feeds + 1])
        ends = np.concatenate([feeds, self.offsets[1:]])
        # A document's end sorts after the feeds inside it, and a start of a document before them.
        rank_s = np.concatenate([np.arange(self.n), self.document_of(feeds)])
        order_s = np.lexsort((starts, rank_s))
        rank_e = np.concatenate([self.document_of(feeds), np.arange(self.n)])
        order_e = np.lexsort((ends, rank_e))
        return starts[order_s], ends[order_e]

    def spans_per_document(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending span starts lie in each document."""
        return np.diff(np.searchsorted(starts, self.offsets))

    def hasher(self) -> "SpanHasher":
        return SpanHasher(self.data)


class SpanHasher:
    """Hashes of any span of a byte array, from two prefix sums modulo a prime.

    Two different spans of n bytes agree with a chance of about ``(n / 2**31) ** 2``
    over the draw of the bases, whatever the bytes: a prime modulus has no texts
    that collide for every base, as powers of two have.
    """

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros((2, len(data) + 1), np.uint64)
        for prefix, codes, powers in zip(self.prefix, _BYTE_CODES, _powers):
            # Folded terms stay below 2**32, so their sums fit for 2**31 bytes.
            np.cumsum(_folded(codes[data] * powers(len(data))[: len(data)]), out=prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        most = int(starts.max(initial=0)) + 1
        first, second = (_remainder(_remainder(prefix[ends] - prefix[starts]) * powers(most)[starts]) for prefix, powers in zip(self.prefix, _inverse_powers))
        with np.errstate(over="ignore"):
            return mix((first << _BITS | second) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents (null: empty) in chunks of about ``most`` bytes, a longer one alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, offsets_buffer, data_buffer = texts.buffers()
    if not n:
        return
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def sums_by_document(values: np.ndarray, starts: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Sums of the values of spans with ascending starts, per document."""
    total = np.concatenate([[0], np.cumsum(values)])
    cuts = np.searchsorted(starts, chunk.offsets)
    return total[cuts[1:]] - total[cuts[:-1]]


def modest_batches(spark: SparkSession) -> None:
    """Lets Spark hand Python at most 1000 rows or about 4 MB at a time, so that long texts need little memory.

    The queries and the pipeline call this; other users of the operators may
    set the same two settings as they like.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
