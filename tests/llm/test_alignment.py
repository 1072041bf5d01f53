from __future__ import annotations

import random

from leadlane.llm.alignment import best_within, distance_within


def columns(a, b, free):
    """Last row of the edit-distance matrix of a pattern and a text; free: the text may be entered anywhere."""
    row = list(range(len(a) + 1))
    out = [row[-1]]
    for j, y in enumerate(b, 1):
        new = [0 if free else j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
        row = new
        out.append(row[-1])
    return out


def test_random_sequences():
    rng = random.Random(5)
    for _ in range(6000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.5:
            b = list(a)
            for _ in range(rng.randint(0, 5)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 1)] = [rng.randint(0, 3)] * rng.randint(0, 1)
        budget = rng.randint(0, 8)
        distance = columns(a, b, False)[-1]
        assert distance_within(a, b, budget) == (distance if distance <= budget else None)
        ends = columns(a, b, True)
        best = (min(ends), ends.index(min(ends)))
        assert best_within(a, b, budget) == (best if best[0] <= budget else None)


def test_long_sequences():
    rng = random.Random(6)
    a = [rng.randint(0, 500) for _ in range(4000)]
    b = a[:1000] + [-1] * 40 + a[1020:3000] + a[3300:]
    distance = columns(a, b, False)[-1]
    assert distance_within(a, b, 400) == distance and distance_within(a, b, distance - 1) is None
