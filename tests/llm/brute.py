"""Plain forms of the operators for small inputs."""

from __future__ import annotations


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ")
    words = [w for w in words if w]
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs: list[tuple[int, str | None]], percent: int = 75) -> list[tuple]:
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(x), root(d), root(d) == d) for d, x in sets]
