"""Features of the lines of a text, for the line classifier."""

from __future__ import annotations

import re
from collections import Counter
from math import log1p

import numpy as np

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 7
_CLASS[list(b" \t\r\x0b\x0c")], _CLASS[list(b".,;:?'\"-()")] = 4, 5
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and _CLASS[b] == 0]] = 6
_UPPER = re.compile(r"[^\W\d_a-z]")

NAMES = (
    "log length", "log words", "lower", "upper", "digits", "spaces", "marks", "symbols", "beyond ASCII", "upper letters", "words all upper", "words with symbols",
    "symbol runs", "equal neighbours", "most common word", "distinct words", "word length", "longest word", "ends like a sentence", "starts with a capital",
    "repeats in document", "periodic words", "single letters", "empty",
)


def features(line: str, repeats: int) -> list[float]:
    """One row of ``NAMES``; ``repeats``: how often the line occurs in its text."""
    raw = line.encode()
    if not raw.strip():
        return [0.0] * (len(NAMES) - 1) + [1.0]
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    n = len(raw)
    words = line.split()
    k = len(words)
    common = Counter(words)
    upper = sum(w.isupper() for w in words)
    odd = sum(not w[-1].isalnum() and (len(w) > 1 and not w[-2].isalnum() or w[-1] not in ".,;:?!'\")") for w in words)
    equal = sum(a == b for a, b in zip(words, words[1:]))
    # words that come again after the same distance as those before them
    last: dict[str, int] = {}
    gaps = Counter()
    for i, w in enumerate(words):
        if w in last:
            gaps[i - last[w]] += 1
        last[w] = i
    letters = count[1] + count[2] + count[7]
    caps = sum(c.isupper() for c in line) if letters else 0
    return [
        log1p(n) / 8, log1p(k) / 6, count[1] / n, count[2] / n, count[3] / n, count[4] / n, count[5] / n, count[6] / n, count[7] / n,
        caps / max(1, len(line)), upper / k, odd / k, min(1.0, line.count("!!") / k + line.count("|") / k), equal / max(1, k - 1), max(common.values()) / k if k > 3 else 0.0,
        len(common) / k, min(2.0, n / k / 10), min(3.0, max(map(len, words)) / 20), float(line.rstrip()[-1] in ".!?"), float(line.lstrip()[0].isupper()),
        min(3.0, log1p(repeats - 1)), max(gaps.values()) / k if gaps and k > 3 else 0.0, sum(len(w) == 1 for w in words) / k, 0.0,
    ]


def rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of the lines before and after it, and the lines' lengths in bytes."""
    lines = text.split("\n")
    times = Counter(lines)
    own = np.array([features(x, times[x]) for x in lines], np.float32)
    edge = np.zeros((1, own.shape[1]), np.float32)
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    return np.concatenate([own, before, after], 1), np.array([len(x.encode()) for x in lines], np.float64)
