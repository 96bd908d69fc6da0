"""A BK-tree under the unrestricted Damerau-Levenshtein distance, which is a metric, so that pruning loses nothing."""

from __future__ import annotations


def distance(a: str, b: str, most: int | None = None) -> int:
    """Fewest insertions, deletions, substitutions and swaps of neighbours, also around later edits.

    With ``most``, any result above it only means that the distance is above it.
    """
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    if not n or not m or (most is not None and abs(n - m) > most):
        return max(n, m) if not n or not m else abs(n - m)
    far = n + m
    last: dict[str, int] = {}
    grid = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        row = [far, i] + [0] * m
        before, seen = grid[i], 0
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), seen
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, seen = 0, j
            row[j + 1] = min(before[j] + cost, row[j] + 1, before[j + 1] + 1, grid[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
        grid.append(row)
    return grid[n + 1][m + 1]


class BKTree:
    """Strings by their distance to their parent; ``within`` visits only what the triangle inequality leaves."""

    def __init__(self, words=()):
        self.root: list | None = None
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = [word, {}]
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [word, {}]
                return
            node = child

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """Every string at most ``most`` away, with its distance."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            other, children = stack.pop()
            d = distance(word, other, most + max(children, default=0))
            if d <= most:
                out.append((other, d))
            stack += [child for step, child in children.items() if d - most <= step <= d + most]
        return out
