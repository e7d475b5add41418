"""Class-conditional Kneser-Ney models over one shared backoff, scored with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from grainmill.llm.text import Chunk

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Stands before the first word of a document.
START = np.uint64(1)


def folded_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the maximal runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    starts, ends = chunk.runs(_WORD_BYTE[chunk.data])
    return starts, Chunk(_FOLD[chunk.data], chunk.offsets).hasher()(starts, ends)


def _shifted(values: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Each word's predecessor in its document."""
    out = np.full(len(values), START)
    inside = document[1:] == document[:-1]
    out[1:][inside] = values[:-1][inside]
    return out


def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, the two words before or START, word) for each word."""
    starts, words = folded_words(chunk)
    document = np.repeat(np.arange(chunk.n), chunk.spans_per_document(starts))
    before = _shifted(words, document)
    return document, _shifted(before, document), before, words


@dataclass(frozen=True)
class KneserNeyRules:
    """``discount`` is taken from each count, all of a smaller one, and its mass goes to the backoff.
    ``strongest``: words of a text whose ratios make the second evidence of ``evidence``."""

    discount: float = 4.0
    strongest: int = 3


@dataclass(frozen=True)
class Counts:
    """Continuation counts with a column for each of the classes 0 and 1.

    ``words``: how many different words come before each word; ``pairs`` (first,
    second): before each pair; ``contexts``: the sum of the latter over all pairs
    with a first word, and of the part of each that the discount takes.
    ``word_totals``, ``word_held`` and ``vocabulary``: sum, discounted part and
    number of all words, the first two by class, and of the classes together.

    Words that are no more than the discount in both classes together, pairs
    that are so in either class, and the contexts of such pairs only may be left
    out: the discount takes all of them, so no probability changes.
    """

    words: np.ndarray
    word_counts: np.ndarray
    firsts: np.ndarray
    seconds: np.ndarray
    pair_counts: np.ndarray
    contexts: np.ndarray
    context_totals: np.ndarray
    context_held: np.ndarray
    word_totals: np.ndarray
    word_held: np.ndarray
    shared_held: float
    vocabulary: int


class KneserNey:
    """Two class models of words in running text over one shared backoff.

    With D the discount and N counting different predecessors, so that copies of
    one text count once::

        P_c(w | u) = max(N_c(u w) - D, 0) / N_c(u) + held_c(u) P_c(w)
        P_c(w)     = max(N_c(w) - D, 0) / N_c + held_c P(w)
        P(w)       = max(N_0(w) + N_1(w) - D, 0) / N + held / (V + 1)

    Each ``held`` is the share of counts that the discount took, so each sums to
    1 over the V words and the unknown one.  A context that a class has not seen
    holds back all; a class without any count has the shared P.
    """

    def __init__(self, counts: Counts, rules: KneserNeyRules = KneserNeyRules()):
        discount = rules.discount
        order = np.argsort(counts.words)
        self.words, n = counts.words[order], counts.word_counts[order].astype(float)
        total, held = counts.word_totals.astype(float), counts.word_held.astype(float)
        everything = max(total.sum(), 1.0)
        self.unknown_shared = (counts.shared_held / everything if total.sum() else 1.0) / (counts.vocabulary + 1)
        shared = np.maximum(n.sum(axis=1) - discount, 0) / everything + self.unknown_shared
        seen = total > 0
        back = np.where(seen, held / np.maximum(total, 1), 1.0)
        self.word_p = np.where(seen, np.maximum(n - discount, 0) / np.maximum(total, 1), 0) + back * shared[:, None]
        self.unknown_p = back * self.unknown_shared

        order = np.argsort(counts.contexts)
        self.contexts = counts.contexts[order]
        totals, kept_back = counts.context_totals[order].astype(float), counts.context_held[order].astype(float)
        self.held_back = np.where(totals > 0, kept_back / np.maximum(totals, 1), 1.0)
        at, known = _find(self.contexts, counts.firsts)
        if not known.all():
            raise ValueError("a pair without its context")
        gain = np.maximum(counts.pair_counts - discount, 0) / np.maximum(totals[at], 1)
        key = _pair_key(counts.firsts, counts.seconds)
        order = np.argsort(key)
        self.pairs, self.pair_gain = key[order], gain[order]

    def probabilities(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """P_0 and P_1 of each word after the one before it."""
        out = self._looked_up(self.words, self.word_p, words, self.unknown_p)
        out *= self._looked_up(self.contexts, self.held_back, before, np.ones(2))
        out += self._looked_up(self.pairs, self.pair_gain, _pair_key(before, words), np.zeros(2))
        return out

    @staticmethod
    def _looked_up(table: np.ndarray, rows: np.ndarray, values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        at, known = _find(table, values)
        out = np.tile(otherwise, (len(values), 1))
        out[known] = rows[at[known]]
        return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second


def evidence(chunk: Chunk, model: KneserNey, strongest: int) -> np.ndarray:
    """Documents x 2: log P_1 - log P_0 a word, over the whole text and over its ``strongest`` words.

    The first is the difference of the two log-likelihoods divided by the number
    of words.  In a long text it hides two telling words, so the second divides
    the largest ratios by ``strongest``, which is the same at every length.  A
    text without words has 0 and 0.
    """
    document, _, before, words = trigrams(chunk)
    if not len(words):
        return np.zeros((chunk.n, 2))
    logs = np.log(model.probabilities(before, words))
    ratio = logs[:, 1] - logs[:, 0]
    counts = np.bincount(document, minlength=chunk.n)
    mean = np.bincount(document, ratio, minlength=chunk.n) / np.maximum(counts, 1)
    order = np.lexsort((-ratio, document))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    top = order[rank < strongest]
    return np.stack([mean, np.bincount(document[top], ratio[top], minlength=chunk.n) / strongest], axis=1)
