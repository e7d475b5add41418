"""Min-cost flow on the small graph of membership patterns and source quotas."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence


def capped_targets(sizes: Mapping[Hashable, int], weights: Mapping[Hashable, float], total: float, most: float) -> dict[Hashable, float]:
    """``total`` shared by weight, no source above ``most`` times its size; what is over is shared again by weight."""
    fixed: dict[Hashable, float] = {}
    open_ = list(sizes)
    while open_:
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if weight <= 0 or left * weights[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / weight for s in open_}
        fixed |= {s: float(most * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in fixed]
    return fixed


def route(patterns: Sequence[tuple[tuple, int]], quotas: Mapping[Hashable, int], repeats: int) -> list[dict[Hashable, int]]:
    """Words of each pattern given to each of its sources.

    ``patterns``: (sources, words) of the documents that lie in just these
    sources.  The r-th pass over a pattern's words costs 2r - 1 a word, so that
    capacity is used evenly before anything repeats; at most ``repeats`` passes.
    All words of a pass cost the same and giving a word to another source costs
    nothing, so the cheapest flow is a largest flow for each pass in turn, in
    what the passes before have left: shortest augmenting paths, all of one
    length at a time.  It meets as much of the quotas as any flow can, at least
    cost.
    """
    flow = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    need = dict(quotas)
    holders: dict[Hashable, dict[int, None]] = {s: {} for s in quotas}  # patterns that give a source words
    for _ in range(repeats):
        room = [words if sources else 0 for sources, words in patterns]
        while _augment(patterns, flow, holders, room, need):
            pass
    return flow


def _augment(patterns, flow, holders, room: list[int], need: dict) -> bool:
    """A blocking flow along the shortest residual paths pattern - source - (pattern - source)*; False if there is none."""
    depth_p: dict[int, int] = {p: 0 for p, left in enumerate(room) if left}
    depth_s: dict[Hashable, int] = {}
    front, depth, reached = [*depth_p], 0, False
    while front and not reached:
        new = []
        for p in front:
            for s in patterns[p][0]:
                if s not in depth_s:
                    depth_s[s] = depth
                    new.append(s)
                    reached |= need[s] > 0
        depth += 1
        front = []
        for s in () if reached else new:
            for p in holders[s]:
                if p not in depth_p:
                    depth_p[p] = depth
                    front.append(p)
    if not reached:
        return False
    ways: dict[tuple, list] = {}  # the next nodes of each node, the one to try last; a dead end is taken off

    def onward(kind: str, x) -> list:
        if (kind, x) not in ways:
            if kind == "p":
                ways[kind, x] = [s for s in reversed(patterns[x][0]) if depth_s.get(s) == depth_p[x]]
            else:
                ways[kind, x] = [p for p in reversed(holders[x]) if depth_p.get(p) == depth_s[x] + 1]
        left = ways[kind, x]
        while left and kind == "s" and not flow[left[-1]][x]:
            left.pop()
        return left

    for start in range(len(room)):
        while room[start]:
            path = [("p", start)]
            while path and not (path[-1][0] == "s" and need[path[-1][1]] > 0):
                kind, x = path[-1]
                if left := onward(kind, x):
                    path.append(("s" if kind == "p" else "p", left[-1]))
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()
            if not path:
                break
            end = path[-1][1]
            amount = min(room[start], need[end], *(flow[b][a] for (_, a), (_, b) in zip(path[1::2], path[2::2])))
            for (kind, a), (_, b) in zip(path, path[1:]):
                p, s, change = (a, b, amount) if kind == "p" else (b, a, -amount)
                flow[p][s] += change
                if flow[p][s]:
                    holders[s][p] = None
                else:
                    holders[s].pop(p, None)
            room[start] -= amount
            need[end] -= amount
    return True
