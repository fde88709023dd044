"""Statistics of a text from its bytes: one histogram, one split into words, one into lines."""

from __future__ import annotations

import math

import numpy as np

SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:?'\"()-", 5), (SYMBOLS + b"!@^_~=+/\\{}[]`", 6)):
    _KIND[list(_chars)] = _k
_KIND[128:192] = 7  # continuation bytes count with their lead byte
_KIND[192:] = 8

#: Order of the values of ``vector``.
NAMES = (
    "log_words", "mean_word", "unique_words", "upper", "digits", "space", "stops", "symbols", "bars", "bangs", "hashes", "wide",
    "log_lines", "repeated_lines", "repeated_line_bytes", "words_a_line", "top_word", "marked_words", "capital_words", "byte_entropy",
)


def vector(text: bytes | None) -> list[float]:
    """Bounded statistics of the whole text, all finite; null, empty and blank texts give zeros."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=counts, minlength=9)
    chars = float(len(text) - kind[7])
    n = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(lines)
    repeated = len(lines) - len(distinct)
    repeated_bytes = len(text) - sum(map(len, distinct)) if repeated else 0
    marked = sum(c for w, c in seen.items() if w[-1] in b"#*$%&|<>!")
    capital = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    share = counts[counts > 0] / len(text)
    return [
        math.log1p(n), min(chars / n, 40.0), len(seen) / n, kind[2] / chars, kind[3] / chars, kind[4] / chars, kind[5] / chars, kind[6] / chars,
        float(counts[124]) / n, float(counts[33]) / n, float(counts[[35, 42, 36, 37, 38]].sum()) / n, kind[8] / chars,
        math.log1p(len(lines)), repeated / max(1, len(lines)), repeated_bytes / len(text), math.log1p(n / max(1, len(lines))),
        max(seen.values()) / n, marked / n, capital / n, float(-(share * np.log2(share)).sum()),
    ]
