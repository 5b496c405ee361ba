"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeated_units(sequences: list, window: int) -> list[list[bool]]:
    counts = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        mark = [False] * len(s)
        for i in range(len(s) - window + 1):
            if counts[tuple(s[i : i + window])] > 1:
                mark[i : i + window] = [True] * window
        out.append(mark)
    return out


def shingles(text: str | None, size: int) -> set:
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


def components(rows: list[tuple], size: int, percent: int) -> list:
    """Least id of each row's component; rows are (id, text)."""
    sets = [shingles(text, size) for _, text in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least: dict[int, list] = {}
    for i, (name, _) in enumerate(rows):
        least.setdefault(find(i), []).append(name)
    ids = {r: min((n for n in names if n is not None), default=None) for r, names in least.items()}
    return [ids[find(i)] for i in range(len(rows))]


def edit_distance_within(pattern: list, text: list) -> int:
    """Least edit distance of the pattern to any run of the text."""
    cost = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, cost = cost, [i]
        for j, b in enumerate(text, 1):
            cost.append(min(before[j - 1] + (a != b), before[j] + 1, cost[j - 1] + 1))
    return min(cost)
