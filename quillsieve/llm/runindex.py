"""A run-length index: the run-compressed Burrows-Wheeler transform of a set of pieces, sampled at the ends of its runs.

Pieces end in separators that differ from each other, so no match crosses one. The index keeps the runs and, for the first
row of each run, where its suffix starts, where the suffix at the end of the run before starts, and how far the two agree.
That is enough to stream over all positions of the text in order: while no run begins, the suffix before a position's
suffix in sorted order moves on by one with it and the length of their match falls by one.
"""

from __future__ import annotations

import numpy as np

_KEY_BITS = 63


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; ``left`` is the number of symbols up to the separator.

    ``text`` holds bytes plus one, with zeros as separators. Equal suffixes of different pieces stay in text order, as
    their separators do.
    """
    n = len(text)
    used = np.flatnonzero(np.bincount(text, minlength=1))
    small = np.zeros(int(used.max(initial=0)) + 1, np.int64)
    small[used] = np.arange(len(used)) + int(used[:1].sum() > 0)
    bits = max(1, int(small.max(initial=0)).bit_length())
    depth = _KEY_BITS // bits  # symbols that one key holds
    padded = np.concatenate([small[text], np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | np.where(left > k, padded[k : k + n], 0)
    order = np.argsort(key)
    open_rows, ranked, rank = np.arange(n), key[order], np.empty(n, np.int64)
    groups, longest = 0, int(left.max(initial=0))
    while True:
        # rows of equal keys are one group, ranked by the first of them; only groups of several rows are sorted again
        new = np.empty(len(ranked), bool)
        new[:1] = True
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(ranked)))
        rank[order[open_rows]] = np.repeat(open_rows[starts], sizes)
        settled = len(starts) == groups
        several = sizes > 1
        open_rows, groups = open_rows[np.repeat(several, sizes)], int(several.sum())
        places = order[open_rows]
        if settled or not groups or depth > longest:
            order[open_rows] = places[np.argsort(rank[places] * (n + 1) + places)]
            return order
        inside = left[places] >= depth
        after = np.where(inside, rank[np.where(inside, places + depth, 0)] + 1, 0)
        key = rank[places] * (n + 1) + after
        by_key = np.argsort(key)
        order[open_rows], ranked = places[by_key], key[by_key]
        depth *= 2


def agreement(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` have in common before a separator."""
    words = np.ndarray((len(text),), "<u8", buffer=np.concatenate([text, np.zeros(16, np.uint16)]).tobytes(), strides=(2,))
    most = np.minimum(left[a], left[b])
    same = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):  # four symbols at a time, then the last ones singly
        at = same[active]
        differs = words[a[active] + at] ^ words[b[active] + at]
        equal = np.where(differs == 0, 4, (np.bitwise_count((differs & -differs) - np.uint64(1)) // 16).astype(np.int64))
        same[active] = np.minimum(at + equal, most[active])
        active = active[(equal == 4) & (same[active] < most[active])]
    return same


class RunIndex:
    """The index of pieces (bytes), concatenated in the order they are given."""

    def __init__(self, pieces: list[bytes]):
        lengths = np.array([len(p) for p in pieces], np.int64)
        #: Where each piece starts in the text; each is followed by one separator.
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        n = int(lengths.sum()) + len(pieces)
        text = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
        #: Symbols up to the end of the piece, from each position.
        self.left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(n)
        order = suffix_order(text, self.left)
        last = text[order - 1]  # the transform; the text is read as a circle
        head = np.empty(n, bool)
        head[:1] = True
        # separators differ from each other, so each is a run of its own
        head[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        rows = np.flatnonzero(head)
        self.n = n
        #: The runs: their symbols and lengths.
        self.run_symbols, self.run_lengths = last[rows], np.diff(np.append(rows, n))
        #: Samples at run ends: suffixes of first rows, and of the rows before them (the ends of the runs before).
        firsts, ends = order[rows], order[rows - 1]
        agreed = agreement(text, self.left, firsts, ends)
        if len(rows):
            ends[0], agreed[0] = firsts[0], 0
        by_place = np.argsort(firsts)
        self.places, self.before, self.agreed = firsts[by_place], ends[by_place], agreed[by_place]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position in text order: the start of the suffix sorted just before its own, and the length of their
        match, which is the longest match of the position with anything sorted before it."""
        spans = np.diff(np.append(self.places, self.n))
        moved = np.arange(self.n) - np.repeat(self.places, spans)
        return np.repeat(self.before, spans) + moved, np.repeat(self.agreed, spans) - moved

    def classes(self, length: int) -> np.ndarray:
        """For every position, one position that stands for all those that agree with it in ``length`` symbols."""
        before, match = self.matching_statistics()
        root = np.where(match >= length, before, np.arange(self.n))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                return root
            root = further

    def repeats(self, length: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose string of ``length`` symbols also starts at a position of lower ``order``, and those that come
        first among equal strings. Strings reach to the end of their piece at most."""
        root = self.classes(length)
        least = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, order)
        whole = self.left >= length
        later = order > least[root]
        return np.flatnonzero(whole & later), np.flatnonzero(whole & ~later)
