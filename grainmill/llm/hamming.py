"""Self-join of 64-bit fingerprints by Hamming distance: node pairs of a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Node pairs that are held as one step of the traversal.
STEP_PAIRS = 1 << 17
#: Node pairs of at most so many fingerprint pairs are compared outright.
LEAF_PAIRS = 24


class Forest:
    """Disjoint sets over 0..n-1 whose root is their smallest member, united in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def _spread(lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, lo, lo + 1, ... : (owner, value)."""
    owner = np.repeat(np.arange(len(lo)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, lo[owner] + within


def link(group: np.ndarray, fingerprints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups: arrays (fingerprint, a smaller one of its component).

    A link joins two fingerprints of a group that differ in ``budget`` bits at
    most.  The fingerprints of a group, in order, are the leaves of a binary
    trie and a node is a range of them.  Pairs of nodes of one depth start with
    each root beside itself and descend together; the bits in which their
    prefixes differ add up, and a pair beyond the budget is dropped with all
    below it.  A pair is also dropped if both nodes already belong to one
    component, which keeps dense groups of copies from costing all their pairs.
    """
    order = np.lexsort((fingerprints, group))
    group, f = group[order], fingerprints[order]
    if len(f):
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (f[1:] != f[:-1])])
        group, f = group[fresh], f[fresh]
    n = len(f)
    forest = Forest(n)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    tails = np.append(heads[1:], n) if n else heads
    # A step: bit to look at, then a's range, b's range and differing bits so far. Last in, first out.
    stack = [(63, heads, tails, heads, tails, np.zeros(len(heads), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        own = alo == blo
        left = np.where(own, (ahi - alo) * (ahi - alo - 1) // 2, (ahi - alo) * (bhi - blo)) > 0
        root = forest.parent
        change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]) if n else root
        left &= ~((root[alo] == root[np.minimum(blo, n - 1)]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[np.minimum(blo, n - 1)])) if len(alo) else left
        alo, ahi, blo, bhi, diff = alo[left], ahi[left], blo[left], bhi[left], diff[left]
        if not len(alo):
            continue
        if len(alo) > STEP_PAIRS:
            for i in reversed(range(0, len(alo), STEP_PAIRS)):
                s = slice(i, i + STEP_PAIRS)
                stack.append((bit, alo[s], ahi[s], blo[s], bhi[s], diff[s]))
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            owner, i = _spread(alo[small], (ahi - alo)[small])
            pair, j = _spread(blo[small][owner], (bhi - blo)[small][owner])
            i = i[pair]
            near = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= budget)
            forest.unite(i[near], j[near])
            keep = ~small
            alo, ahi, blo, bhi, diff = alo[keep], ahi[keep], blo[keep], bhi[keep], diff[keep]
            if not len(alo):
                continue
        ones = np.concatenate([[0], np.cumsum((f >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = alo == blo
        other = ~own
        same = (np.concatenate([alo, amid]), np.concatenate([amid, ahi]), np.concatenate([blo, bmid]), np.concatenate([bmid, bhi]), np.concatenate([diff, diff]))
        apart = (np.concatenate([alo, amid[other]]), np.concatenate([amid, ahi[other]]), np.concatenate([bmid, blo[other]]), np.concatenate([bhi, bmid[other]]), np.concatenate([diff, diff[other]]) + np.int8(1))
        full = lambda p: (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)
        stack.append((bit - 1, *(x[full(apart)] for x in apart)))
        stack.append((bit - 1, *(x[full(same)] for x in same)))  # nearer pairs first
    child = np.flatnonzero(forest.parent != np.arange(n))
    return f[child], f[forest.parent[child]]


def block_masks(budget: int, equal: int, within: int = (1 << 64) - 1) -> Iterator[int]:
    """Masks of ``equal`` of ``budget + equal`` blocks of the bits ``within``: two values within the budget agree on one of them at least."""
    places = [1 << b for b in range(64) if within >> b & 1]
    n = budget + equal
    edges = [len(places) * i // n for i in range(n + 1)]
    masks = [sum(places[i:j]) for i, j in zip(edges, edges[1:])]
    for chosen in combinations(masks, equal):
        yield sum(chosen)


def equal_blocks(n: int, budget: int, load: int, bits: int = 64) -> int:
    """The fewest equal blocks for which n spread-out values of so many bits give buckets of about ``load`` at most."""
    equal = 1
    while n / 2.0 ** (bits // (budget + equal) * equal) > load and equal < 4:
        equal += 1
    return equal
