"""One-to-one matching where many nodes share a place: places with their numbers of nodes are matched, not nodes; and matching along a line."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: a cell's admissible places kept for the next search, in entries over all rows
_KEPT = 8_000_000


def transport(supply: list[int], demand: list[int], near: Callable[[int], tuple[np.ndarray, np.ndarray]], most: float, same: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """Row, column, units of a flow of the most units, of these the cheapest in sum.

    ``near``: the columns that a row may send to, with costs from 0 to ``most``; ``same``: rows and columns at no distance. Shortest augmenting paths with potentials from
    place to place, as many units at once as the path takes; to stay behind costs more than any number of units can save. The costs are asked for row by row, so the
    memory is that of the places, not of their pairs. Best if the supply is the smaller side.
    """
    n, m = len(supply), len(demand)
    alone = 1.0 + 2.0 * most * (1 + min(n, m))  # no path is longer than twice the places
    value, price = np.zeros(n), np.zeros(m)
    left, rest = list(supply), list(demand)
    flow: list[dict[int, int]] = [{} for _ in range(m)]
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    room = _KEPT

    def edges(row: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal room
        if row in kept:
            return kept[row]
        got = near(row)
        if room > 0:
            room -= len(got[0])
            kept[row] = got
        return got

    for i, j in same:  # at price 0 these are cheapest ways
        units = min(left[i], rest[j])
        if units:
            flow[j][i] = flow[j].get(i, 0) + units
            left[i] -= units
            rest[j] -= units
    for start in range(n):
        while left[start]:
            dist, open_ = np.full(m, np.inf), np.full(m, np.inf)
            came = np.full(m, -1)
            at, via = {start: 0.0}, {start: -1}
            done: list[int] = []
            low, best, last, end = 0.0, np.inf, -1, -1
            rows = [start]
            while True:
                for row in rows:
                    if low + alone - value[row] < best:
                        best, last = low + alone - value[row], row
                    cols, cost = edges(row)
                    reach = np.maximum(low, cost - price[cols] + (low - value[row]))
                    better = reach < dist[cols]
                    to, reach = cols[better], reach[better]
                    dist[to] = open_[to] = reach
                    came[to] = row
                col = int(open_.argmin())
                if open_[col] >= best:
                    low = best
                    break
                low = float(open_[col])
                if rest[col]:
                    end = col
                    break
                open_[col] = np.inf
                done.append(col)
                rows = [r for r in flow[col] if r not in at]
                for r in rows:
                    at[r], via[r] = low, col
            for r, d in at.items():
                value[r] += low - d
            price[done] -= low - dist[done]
            path: list[tuple[int, int]] = []  # (row, column it takes more of), from the end
            row, units = (last, left[start]) if end < 0 else (int(came[end]), min(left[start], rest[end]))
            path.append((row, end))
            while row != start:
                col = via[row]
                units = min(units, flow[col][row])
                row, _ = int(came[col]), path.append((int(came[col]), col))
            for row, col in path:
                if col >= 0:
                    flow[col][row] = flow[col].get(row, 0) + units
                if (old := via[row]) >= 0:
                    flow[old][row] -= units
                    if not flow[old][row]:
                        del flow[old][row]
            left[start] -= units
            if end >= 0:
                rest[end] -= units
    return [(i, j, k) for j in range(m) for i, k in sorted(flow[j].items())]


def line_matching(left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, cost: Callable[[int, slice], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of two sorted lists: as many as possible, of these the cheapest in sum of whole costs.

    Left i may have the right ones from ``first[i]`` up to ``last[i]``, which never fall; ``cost``: whole numbers for a left one and a run of right ones. Where the cost is a rising function of the distance with no
    gain in crossing, some best matching crosses nowhere, so the lists are walked once; of each admissible pair two bits are kept.
    """
    n, m = len(left), len(right)
    top = max((int(cost(i, slice(first[i], last[i])).max()) for i in range(n) if first[i] < last[i]), default=0)
    pair = 1 + top * min(n, m)
    if pair * min(n, m) >= 2**62:
        raise ValueError("the sum of costs does not fit a long")
    best = np.zeros(m + 1, np.int64)  # of the left ones so far and the right ones before a place
    reached = 0
    up, back = [], []
    for i in range(n):
        a, b = int(first[i]), int(last[i])
        if a >= b:
            up.append(None)
            back.append(None)
            continue
        if b > reached:
            best[reached + 1 : b + 1] = best[reached]
            reached = b
        old = best[a + 1 : b + 1].copy()
        taken = best[a:b] + (pair - cost(i, slice(a, b)))
        new = np.maximum.accumulate(np.maximum(np.maximum(old, taken), best[a]))
        up.append(np.packbits(new == old))
        back.append(np.packbits(new == np.concatenate([best[a : a + 1], new[:-1]])))
        best[a + 1 : b + 1] = new
    out = []
    j = reached
    for i in range(n - 1, -1, -1):
        a, b = int(first[i]), int(last[i])
        if up[i] is None:
            continue
        j = min(j, b)
        if j <= a:
            continue
        ups, backs = np.unpackbits(up[i], count=b - a), np.unpackbits(back[i], count=b - a)
        while j > a and not ups[j - a - 1] and backs[j - a - 1]:
            j -= 1
        if j > a and not ups[j - a - 1]:
            j -= 1
            out.append((i, j))
    return out[::-1]
