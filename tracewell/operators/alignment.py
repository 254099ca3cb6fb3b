"""Alignment of two sequences by their longest common subsequence, in bounded memory."""

from __future__ import annotations

import numpy as np


def _row(below: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences one element earlier: ``same`` says where that element stands in the other sequence.

    Lengths never rise along a row, so the best of what follows is a running maximum from the end.
    """
    best = below.copy()
    np.maximum(best[:-1], np.where(same, below[1:] + 1, 0), out=best[:-1])
    return np.maximum.accumulate(best[::-1])[::-1]


def align(a: list, b: list, first: str = "a") -> list[tuple[int | None, int | None]]:
    """A longest common subsequence of ``a`` and ``b`` as pairs of places; what is in one alone has None in the other.

    Read from the start: equal elements are matched where they meet; else the side goes on that keeps more in common, and
    of equal ones ``first`` ("a" or "b"). Of the table of lengths every so many rows are kept and the others made again as
    they are needed, so memory is some 8 (len(a))^(1/2) len(b) bytes.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(lo)]
    number: dict = {}
    x = [number.setdefault(v, len(number)) for v in a[lo:]]
    y = np.array([number.setdefault(v, len(number)) for v in b[lo:]], np.int64)
    step = max(1, int(len(x) ** 0.5))
    kept = {len(x): np.zeros(len(y) + 1, np.int32)}  # the row of the lengths from there on
    row = kept[len(x)]
    for i in range(len(x) - 1, 0, -1):
        row = _row(row, y == x[i])
        if i % step == 0:
            kept[i] = row
    i = j = 0
    rows: dict[int, np.ndarray] = {}
    while i < len(x) and j < len(y):
        if i not in rows or i + 1 not in rows:
            top = min(len(x), (i // step + 1) * step)
            rows = {top: kept[top]}
            for k in range(top - 1, i - 1, -1):
                rows[k] = _row(rows[k + 1], y == x[k])
        if x[i] == y[j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
            continue
        without_a, without_b = rows[i + 1][j], rows[i][j + 1]
        if without_a > without_b or (without_a == without_b and first == "a"):
            out.append((lo + i, None))
            i += 1
        else:
            out.append((None, lo + j))
            j += 1
    return out + [(lo + k, None) for k in range(i, len(x))] + [(None, lo + k) for k in range(j, len(y))]
