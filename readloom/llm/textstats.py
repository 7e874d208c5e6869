"""Document statistics: the counts that the quality rules are defined on, and the features that models learn from.

A word is a maximal run of characters other than the ASCII white space (space, tab, LF, VT, FF, CR). A null text has
no words. All functions look at the whole text.
"""

from __future__ import annotations

import math

import numpy as np

from .common import ASCII_SPACE

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Names of the features, in the order of :func:`features`.
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "bars_per_word", "bangs_per_word", "punctuation_per_word",
    "upper_share", "digit_share", "dup_line_share", "repeat_word_share", "adjacent_repeat_share", "distinct_share",
    "top_word_share", "short_word_share", "line_words",
)

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeated_word_mask(ids: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that is found twice or more; ``ids`` numbers the words by equality."""
    n = len(ids)
    covered = np.zeros(n, dtype=bool)
    if n < 4:
        return covered
    # pair ids are renumbered before the third word is added, so that the keys can't overflow at any length
    width = np.int64(ids.max()) + 1
    if width < 2_000_000:
        keys = (ids[:-2].astype(np.int64) * width + ids[1:-1]) * width + ids[2:]
    else:
        _, pair = np.unique(ids[:-1].astype(np.int64) * width + ids[1:], return_inverse=True)
        keys = pair[:-1].astype(np.int64) * width + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return covered


def n_dup_lines(raw: bytes) -> int:
    """Lines (split at LF) that hold a word and equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) < 2:
        return 0
    held = [x for x in lines if x.strip(ASCII_SPACE)]
    return len(held) - len(set(held))


def statistics(raw: bytes | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features) of a UTF-8 text."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    code_points = len(raw.decode("utf-8", "replace"))
    chars = code_points - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = n_dup_lines(raw)
    if not n:
        return (0, chars, symbols, dup, 0), [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    repeat = int(repeated_word_mask(ids).sum())
    counts = np.bincount(ids)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    short = sum(1 for w in words if len(w) <= 3)
    lines = raw.count(b"\n") + 1
    letters = max(1, chars)
    feats = [
        math.log1p(n), chars / n, symbols / n, raw.count(b"|") / n, raw.count(b"!") / n,
        (raw.count(b".") + raw.count(b",") + raw.count(b";") + raw.count(b":")) / n,
        upper / letters, (len(raw) - len(raw.translate(None, _DIGITS))) / letters, dup / lines, repeat / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, len(counts) / n, float(counts.max()) / n, short / n,
        n / lines,
    ]
    return (n, chars, symbols, dup, repeat), feats


def features(raw: bytes | None) -> list[float]:
    return statistics(raw)[1]
