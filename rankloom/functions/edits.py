"""Edit distance with swaps of neighbours, cut off at a bound; plain Python for use inside Arrow batches."""

from __future__ import annotations


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two strings; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a or not b:
        return min(len(a) or len(b), most + 1)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        lo, hi = max(1, i - most), min(len(b), i + most)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = last[j - 1] + (x != y)
            if last[j] + 1 < v:
                v = last[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            row[j] = v
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)
