"""Minimal line diffs by Myers' greedy search (1986), in linear space."""

from __future__ import annotations

from collections.abc import Sequence


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """The middle run of matches (from x, y; to u, v) of a shortest edit script, met by searches from both ends."""
    n, m = len(a), len(b)
    delta, size = n - m, n + m + 2
    ahead, back = [0] * (2 * size + 1), [0] * (2 * size + 1)
    for d in range((n + m + 1) // 2 + 1):
        for far, other, forward in ((ahead, back, True), (back, ahead, False)):
            # diagonals outside of the box are left out
            low, high = max(-d, -m + ((d - m) & 1)), min(d, n - ((d - n) & 1))
            for k in range(low, high + 1, 2):
                x = far[size + k + 1] if k == -d or (k != d and far[size + k - 1] < far[size + k + 1]) else far[size + k - 1] + 1
                y, start = x - k, x
                if forward:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                far[size + k] = x
                reach = d - 1 if forward else d
                if (delta & 1) == forward and abs(delta - k) <= reach and x + other[size + delta - k] >= n:
                    return (start, start - k, x, y) if forward else (n - x, m - y, n - start, m - (start - k))
    raise AssertionError("searches from both ends meet")


def matches(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Places (in old, in new) of lines that stay, ascending; no other choice keeps more lines.

    Common ends are cut first, and lines that only one side has can't stay; so the search sees what really differs, and its
    time is the number of these lines times the number of edits among them.
    """
    head, most = 0, min(len(old), len(new))
    while head < most and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    names = {line: k for k, line in enumerate(dict.fromkeys(old[head : len(old) - tail]))}
    there = set(new[head : len(new) - tail])
    left = [i for i in range(head, len(old) - tail) if old[i] in there]
    right = [j for j in range(head, len(new) - tail) if new[j] in names]
    a, b = [names[old[i]] for i in left], [names[new[j]] for j in right]
    found = [(i, i) for i in range(head)] + [(len(old) - k, len(new) - k) for k in range(1, tail + 1)]
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, to_i, j, to_j = parts.pop()
        while i < to_i and j < to_j and a[i] == b[j]:
            found.append((left[i], right[j]))
            i, j = i + 1, j + 1
        while i < to_i and j < to_j and a[to_i - 1] == b[to_j - 1]:
            to_i, to_j = to_i - 1, to_j - 1
            found.append((left[to_i], right[to_j]))
        if i < to_i and j < to_j:
            x, y, u, v = _middle(a[i:to_i], b[j:to_j])
            found += [(left[i + k], right[j + y - x + k]) for k in range(x, u)]
            parts += [(i, i + x, j, j + y), (i + u, to_i, j + v, to_j)]
    return sorted(found)


def line_diff(old: str, new: str) -> tuple[int, int, int, str]:
    """Lines that stay, that come and that go, and the changed ones in order: "-" and those that go, then "+" and those that come."""
    a, b = old.split("\n"), new.split("\n")
    kept = matches(a, b)
    shown, i, j = [], 0, 0
    for x, y in [*kept, (len(a), len(b))]:
        shown += [f"-{line}" for line in a[i:x]] + [f"+{line}" for line in b[j:y]]
        i, j = x + 1, y + 1
    return len(kept), len(b) - len(kept), len(a) - len(kept), "\n".join(shown)
