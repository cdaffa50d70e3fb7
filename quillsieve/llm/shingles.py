"""Word shingles as 64-bit hashes, over many texts at once with numpy.

A word is a run of Unicode letters, digits and the marks that combine with them, lower case; everything else parts words. In
scripts that are written without spaces every letter, with its marks, is a word.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import regex

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Scripts written without spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_LETTER, _SINGLE, _MARK = 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """By code point: 0 parts words, else a letter or digit, a letter that is a word, or a mark."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    points = "".join(chr(c) for c in range(sys.maxunicode + 1))
    scripts = "".join(rf"\p{{{script}}}" for script in UNSPACED)
    for kind, pattern in ((_LETTER, r"[\p{L}\p{N}]+"), (_SINGLE, rf"(?V1)[[\p{{L}}\p{{N}}]&&[{scripts}]]+"), (_MARK, r"\p{M}+")):
        for found in regex.finditer(pattern, points):
            out[found.start() : found.end()] = kind
    return out


def _word_edges(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in a stream of code points."""
    kind = _classes()[stream]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]]) if len(kind) else kind
    # the kind of the last character before that is not a mark tells whether a word of one letter has just ended
    place = np.where(before != _MARK, np.arange(len(kind)), 0)
    base = before[np.maximum.accumulate(place)] if len(kind) else kind
    starts = (kind > 0) & ((before == 0) | (kind == _SINGLE) | ((kind == _LETTER) & (base == _SINGLE)))
    after = np.concatenate([kind[1:], np.zeros(1, np.uint8)]) if len(kind) else kind
    follows = np.concatenate([starts[1:], np.zeros(1, bool)]) if len(kind) else starts
    return np.flatnonzero(starts), np.flatnonzero((kind > 0) & ((after == 0) | follows)) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """The words of several texts, lower case, in order: their 64-bit hashes and the text of each."""

    def __init__(self, texts: list[str]):
        # a line feed ends each text, so no word reaches into the next one
        data = [t.lower() + "\n" for t in texts]
        stream = np.frombuffer("".join(data).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(d) for d in data])
        starts, stops = _word_edges(stream)
        with np.errstate(over="ignore"):
            # hash of a word: the sum of code point * odd ** (place in the word), from sums over the whole stream
            up = _powers(int(_ODD), len(stream))
            total = np.zeros(len(stream) + 1, dtype=np.uint64)
            np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            down = _powers(_inverse(int(_ODD)), len(stream))
            self.hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        self.text = np.searchsorted(ends, starts, side="right")
        self.count = np.bincount(self.text, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text of each, in order; repeats are kept.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words = Words(texts)
    n = len(words.hashes)
    first = np.concatenate([[0], np.cumsum(words.count)])[:-1] if len(texts) else np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        power = np.uint64(1)
        last = (first + words.count)[words.text] if n else np.zeros(0, dtype=np.int64)
        place = np.arange(n)
        for i in range(width):
            power = power * _STEP
            at = place + i
            there = at < last
            total += np.where(there, words.hashes[np.minimum(at, n - 1)] * power, np.uint64(0)) if n else 0
        hashes = mix(total)
    whole = (place + width <= last) | ((words.count[words.text] < width) & (place == first[words.text])) if n else []
    return (hashes[whole], words.text[whole]) if n else (hashes, words.text)


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each occurs, sorted by text, then hash."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    if not len(h):
        return h, t, np.zeros(0, dtype=np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    return h[fresh], t[fresh], np.diff(np.append(fresh, len(h)))
