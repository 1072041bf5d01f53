"""Banded alignment with bit vectors: a column of the edit-distance matrix is one Python integer.

Neighbouring cells differ by at most one, so a column is held as the bits of its rises and falls and moves on with a
few additions and shifts. Only the cells within a band of diagonals are kept.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def distance_within(a: Sequence[Hashable], b: Sequence[Hashable], budget: int) -> int | None:
    """The edit distance of two sequences if it is at most ``budget``, else None."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > budget:
        return None
    start, stop = 0, len(b)
    while start < stop and a[start] == b[start]:
        start += 1
    gap = len(a) - len(b)
    while stop > start and a[stop + gap - 1] == b[stop - 1]:
        stop -= 1
    rows, columns = a[start : stop + gap], b[start:stop]
    if not columns:
        return len(rows)
    if budget == 0:
        return None
    return _banded(rows, columns, min(budget, len(rows)))


def _banded(rows: Sequence[Hashable], columns: Sequence[Hashable], budget: int) -> int | None:
    """Distance along the band of ``budget`` diagonals on either side; ``rows`` is the longer sequence.

    In column j, bit k stands for row j - budget + k, so the band stays in place while the matrix passes below it.
    Rows above the matrix are taken to fall by one each, which agrees with its first row. The value of the band's
    lowest cell is followed down its diagonal, and from the last row on along that row.
    """
    n, m, width = len(rows), len(columns), 2 * budget + 1
    full, low = (1 << width) - 1, width - 1
    where: dict[Hashable, int] = {}
    for i, x in enumerate(rows):
        where[x] = where.get(x, 0) | 1 << (i + budget)
    fall = (1 << budget) - 1
    rise = full ^ fall
    value = budget
    sideways = m - n + budget
    for j, x in enumerate(columns):
        match = (where.get(x, 0) >> j) & full
        diagonal = ((((match & rise) + rise) ^ rise) | match | fall) & full
        up = (fall | ~(diagonal | rise)) & full
        down = diagonal & rise
        last = n - 1 - j + budget
        if last >= low:
            value += not diagonal >> low
        else:
            value += (up >> last & 1) - (down >> last & 1)
        # Each step that is left along the last row lowers the value by one at most.
        if value - min(sideways, m - 1 - j) > budget:
            return None
        shifted = diagonal >> 1
        rise = (down | ~(shifted | up)) & full
        fall = shifted & up
    return value if value <= budget else None


def best_within(pattern: Sequence[Hashable], region: Sequence[Hashable], budget: int) -> tuple[int, int] | None:
    """The smallest edit distance of ``pattern`` to any part of ``region`` and where that part ends.

    The region is a band of diagonals cut out of a text by the caller. None if the distance exceeds ``budget``; among
    equal distances the first end counts.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[Hashable, int] = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    rise, fall, value = full, 0, m
    best = (m, 0)
    for j, x in enumerate(region):
        match = where.get(x, 0)
        diagonal = (((match & rise) + rise) ^ rise) | match | fall
        up, down = fall | ~(diagonal | rise), diagonal & rise
        value += bool(up & top) - bool(down & top)
        up, down = up << 1, down << 1
        rise = (down | ~(diagonal | up)) & full
        fall = diagonal & up & full
        if value < best[0]:
            best = (value, j + 1)
    return best if best[0] <= budget else None
