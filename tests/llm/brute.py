"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hash_text(text: str, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed=seed)


def hash_longs(*values: int) -> int:
    """Spark's xxhash64 of long columns, unsigned."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & (1 << 64) - 1), seed=seed)
    return seed


def quality_rows(docs, labels, buckets, spreads):
    """{doc_id: row} for documents [(doc_id, text)] and labels [(doc_id, quality, toxic)]."""
    trusted = {d for d, q, t in labels if q == 1 and not t and d is not None}
    grams, all_n, good_n = {}, Counter(), Counter()
    for k, (d, text) in enumerate(docs):
        h = [hash_text(w) for w in WORD.findall(text or "")]
        grams[k] = [x % buckets for x in h] + [hash_longs(a, b) % buckets for a, b in zip(h, h[1:])]
        all_n.update(grams[k])
        if d in trusted:
            good_n.update(grams[k])
    every, chosen = sum(all_n.values()) + buckets, sum(good_n.values()) + buckets
    weight = lambda b: (math.log((good_n[b] + 1) / chosen) - math.log((all_n[b] + 1) / every)) if good_n else 0.0
    score = {k: sum(map(weight, g)) / len(g) if g else None for k, g in grams.items()}
    known = sorted(score[k] for k, (d, _) in enumerate(docs) if d in trusted and score[k] is not None)

    def quantile(q):
        at = q * (len(known) - 1)
        low = int(at)
        return known[low] + (at - low) * (known[min(low + 1, len(known) - 1)] - known[low])

    threshold = quantile(0.5) - spreads * (quantile(0.5) - quantile(0.05)) if known else -math.inf
    rows = []
    for k, (d, text) in enumerate(docs):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        repeated = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        rows.append(
            {
                "doc_id": d,
                "n_words": len(words),
                "word_chars": sum(map(len, words)),
                "n_symbols": sum(c in "#*$%&|<>" for c in text),
                "n_dup_lines": len(lines) - len(set(lines)),
                "n_repeat_words": len(repeated),
                "base_failed": failed,
                "score": score[k],
                "margin": None if score[k] is None else score[k] - threshold,
                "kept": not failed and score[k] >= threshold,
            }
        )
    return rows
