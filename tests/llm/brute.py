"""Plain versions of shared steps."""

from __future__ import annotations


def components(n: int, pairs) -> list[int]:
    """Smallest index reachable of every index: a plain union-find."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
