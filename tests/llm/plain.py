"""Plain versions of the operators, without Spark, for small tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import regex


UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
WORD = regex.compile(rf"(?V1)[[\p{{L}}\p{{N}}]&&{UNSPACED}]\p{{M}}*|(?:\p{{M}}|[[\p{{L}}\p{{N}}]--{UNSPACED}])+")


def runs(text: str, width: int = 5) -> Counter:
    words = WORD.findall(text.lower())
    if not words:
        return Counter()
    if len(words) < width:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def near_classes(texts: list[str], threshold: float = 0.8) -> list[int]:
    """Index of the first text of each text's class, from all pairs."""
    parent = list(range(len(texts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = sorted((find(i), find(j)))
        parent[b] = a

    bags = [runs(t) for t in texts]
    for i, a in enumerate(bags):
        for j in range(i):
            if texts[i] == texts[j] or (a and bags[j] and similarity(a, bags[j]) >= threshold):
                union(i, j)
    return [find(i) for i in range(len(texts))]


def water_fill(sizes: list[int], weights: list[int], share: float = 1.5, epochs: int = 2) -> list[float]:
    """Targets by rounds of clamping."""
    budget, clamped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        left = budget - sum(epochs * sizes[i] for i in clamped)
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > epochs * sizes[i]} if total else set()
        if not over:
            return [epochs * s if i in clamped else left * weights[i] / total for i, s in enumerate(sizes)]
        clamped |= over


def xx_uniform(level: str, child: int, key: str) -> float:
    import xxhash

    drawn = xxhash.xxh64_intdigest(f"{level}:{child}:{key}".encode(), seed=42)
    return (drawn % (1 << 53) + 0.5) / (1 << 53)


def tree_shard(key: str, weights: list[float], rack: int = 4, racks: int = 2) -> int:
    def sums(values: list[float], size: int) -> list[float]:
        return [sum(values[i : i + size]) for i in range(0, len(values), size)]

    def best(level: str, children: range, of: list[float]) -> int:
        return min((-math.log(xx_uniform(level, c, key)) / of[c], c) for c in children if of[c] > 0)[1]

    by_rack = sums(weights, rack)
    by_region = sums(by_rack, racks)
    region = best("region", range(len(by_region)), by_region)
    chosen = best("rack", range(region * racks, min((region + 1) * racks, len(by_rack))), by_rack)
    return best("shard", range(chosen * rack, min((chosen + 1) * rack, len(weights))), weights)


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def exact(rows: list[tuple]) -> list[tuple]:
    """``doc_id, keep_id, group_size, kept, sha256`` of (id, text) rows with distinct ids."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out
