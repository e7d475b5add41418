"""Deep-shallow ordering of suffixes: multikey partitioning first, blind tries for what still ties."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey partitioning looks at, eight at a time.
SHALLOW = 8
#: Suffixes whose bytes one step of the blind tries compares.
STEP = 1 << 16


def _split(order: np.ndarray, classes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders each class (a run of ``order``) by key; the classes that result, in order."""
    within = np.lexsort((keys, classes))
    order, classes, keys = order[within], classes[within], keys[within]
    fresh = np.concatenate([[False], (classes[1:] != classes[:-1]) | (keys[1:] != keys[:-1])])
    return order, np.cumsum(fresh)


def _shared(classes: np.ndarray) -> np.ndarray:
    """Flags of the members of classes of two or more, classes being runs."""
    same = classes[1:] == classes[:-1]
    flags = np.zeros(len(classes), bool)
    flags[1:] |= same
    flags[:-1] |= same
    return flags


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte most significant."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


def _first_difference(xor: np.ndarray) -> np.ndarray:
    """The first differing byte of eight; 8 for none."""
    at = np.full(xor.shape, 8)
    for i in reversed(range(8)):
        at[(xor >> np.uint64(56 - 8 * i)) != 0] = i
    return at


def equal_suffixes(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, width: int) -> np.ndarray:
    """Flags of the suffixes whose first ``width`` bytes begin another suffix of their group too.

    Every suffix must have ``width`` bytes.  Multikey quicksort, eight bytes to
    a key, orders the suffixes of each group to a shallow depth; suffixes alone
    in their class are done.  A remaining class, with a long common prefix,
    becomes a blind trie: its members are compared with one of them to find
    where the class first branches, bytes before that are skipped, and the
    bytes at the branch deal them to child nodes, until a node holds one suffix
    or one string of ``width`` bytes.
    """
    found = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return found
    eights = _eights(data)
    order = np.argsort(groups, kind="stable")
    ranked = groups[order]
    classes = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
    keep = _shared(classes)
    order, classes = order[keep], classes[keep]
    depth = 0
    while depth < min(SHALLOW, width) and len(order):
        size = min(8, width - depth)
        order, classes = _split(order, classes, eights[starts[order] + depth] >> np.uint64(64 - 8 * size))
        keep = _shared(classes)
        order, classes = order[keep], classes[keep]
        depth += size
    if depth >= width:
        found[order] = True
        return found
    depths = np.full(len(order), depth)
    while len(order):
        heads = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        sizes = np.diff(np.append(heads, len(order)))
        first = starts[order[np.repeat(heads, sizes)]]
        own = starts[order]
        branch = np.full(len(order), width)
        for i in range(0, len(order), STEP):
            s = slice(i, i + STEP)
            open_, at = np.arange(i, min(i + STEP, len(order))), depths[s].copy()
            while len(open_):
                xor = eights[own[open_] + at] ^ eights[first[open_] + at]
                step = _first_difference(xor)
                ends = np.minimum(at + step, width)
                done = (step < 8) | (ends >= width)
                branch[open_[done]] = ends[done]
                open_, at = open_[~done], ends[~done]
        branch = np.repeat(np.minimum.reduceat(branch, heads), sizes)
        equal = branch >= width
        found[order[equal]] = True
        order, classes, branch = order[~equal], classes[~equal], branch[~equal]
        if not len(order):
            break
        # Members of a class share their branching depth, so it stays in place as they are reordered.
        order, classes = _split(order, classes, data[starts[order] + branch])
        keep = _shared(classes)
        order, classes, depths = order[keep], classes[keep], branch[keep] + 1
        done = depths >= width
        if done.any():
            found[order[done]] = True
            order, classes, depths = order[~done], classes[~done], depths[~done]
    return found
