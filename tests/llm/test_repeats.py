"""Removal of repeated passages, against every string of the given length."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quillsieve.llm import queries, repeats
from quillsieve.llm.runindex import RunIndex


def plain(rows, length):
    """(removed spans, what is left) by distinct (id, text), from the first place of every string."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0], d[1]))
    first, out = {}, {}
    for n, (_, text) in enumerate(docs):
        data = text.encode()
        for at in range(len(data) - length + 1):
            first.setdefault(data[at : at + length], (n, at))
    for n, (own, text) in enumerate(docs):
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - length + 1):
            if first[data[at : at + length]] != (n, at):
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = [tuple(p) for p in edges.reshape(-1, 2).tolist()]
        out[own, text] = (spans, bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]))
    return out


def random_pieces(rnd):
    letters = rnd.choice([b"ab", b"abc", bytes(range(256))])
    base = bytes(rnd.choice(letters) for _ in range(60))
    for _ in range(rnd.randrange(1, 8)):
        piece = bytearray(base[rnd.randrange(20) : rnd.randrange(30, 60)])
        if rnd.random() < 0.3:
            piece = bytearray(rnd.choice(letters) for _ in range(rnd.randrange(30)))
        if piece and rnd.random() < 0.5:
            piece[rnd.randrange(len(piece))] = rnd.choice(letters)
        yield bytes(piece)


def test_index_has_a_sorted_transform():
    """Runs, samples and matching statistics against sorted suffixes."""
    rnd = random.Random(4)
    for _ in range(100):
        pieces = list(random_pieces(rnd))
        index = RunIndex(pieces)
        suffixes = sorted(
            (piece[k:], i, int(start) + k) for i, (start, piece) in enumerate(zip(index.starts, pieces)) for k in range(len(piece) + 1)
        )
        order = [s[2] for s in suffixes]
        text = [c for piece in pieces for c in [*(b + 1 for b in piece), 0]]
        assert np.repeat(index.run_symbols, index.run_lengths).tolist() == [text[p - 1] for p in order]
        before, match = index.matching_statistics()
        for (a, _, p), (b, _, q) in zip(suffixes, suffixes[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert (before[q], match[q]) == (p, same)


@pytest.mark.parametrize("length", [1, 3, 8])
def test_index_marks_what_starts_earlier(length):
    rnd = random.Random(length)
    for _ in range(100):
        pieces = list(random_pieces(rnd))
        index, seen, later, first = RunIndex(pieces), set(), [], []
        for start, piece in zip(index.starts.tolist(), pieces):
            for at in range(len(piece) - length + 1):
                (later if piece[at : at + length] in seen else first).append(start + at)
                seen.add(piece[at : at + length])
        got = index.repeats(length, np.arange(index.n))
        assert [g.tolist() for g in got] == [later, first]


def test_equal_strings_have_equal_anchors():
    rnd = random.Random(7)
    docs = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(300))) for _ in range(30)]
    shared = docs[5][50:150] if len(docs[5]) >= 150 else bytes(100)
    docs += [b"x" * 30 + shared, shared, shared + b"y" * 200, b"z" * 400]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    places, hashes = repeats.anchors(np.frombuffer(b"".join(docs), np.uint8), ends)
    found = {}
    for n, doc in enumerate(docs):
        for at in range(len(doc) - 99):
            low = ends[n] + at
            own = hashes[(places >= low) & (places <= low + 68)]
            assert len(own)
            window = doc[at : at + 100]
            assert found.setdefault(window, own.min()) == own.min()


def collected(found):
    return sorted(((r[0], r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()), key=str)


def expected(rows, length):
    by_row = plain(rows, length)
    return sorted(((i, len((t or "").encode()), *by_row[i, t or ""]) for i, t in rows), key=str)


@pytest.mark.parametrize("chunk", [2_000, repeats.CHUNK])
def test_small_tables(spark, chunk):
    """Passages inside passages, chains, texts that repeat themselves, and a passage that a third of all rows hold."""
    rnd = random.Random(11)
    words = ["w%d" % i for i in range(400)] + ["é", "中文", "a  b"]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(15, 120))) for _ in range(12)]
    rows = []
    for i in range(250):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            parts.append(p[rnd.randrange(len(p) // 3) : len(p) - rnd.randrange(len(p) // 3)])
            parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 10))))
        if i % 3 == 0:
            parts.append(passages[0])
        rows.append((i, "".join(parts)))
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, "ab" * 700), (401, "x" * 99), (402, "ab" * 60), (403, None), (404, "")]
    rows += [(500, rows[0][1] + " and more"), (5, rows[5][1])]
    schema = "doc_id bigint, text string, dk string, data string, slice string, start string, named string"
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], schema).repartition(4)
    assert collected(repeats.remove_repeats(df, chunk=chunk)) == expected(rows, 100)


def test_edge_rows(spark, edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert collected(repeats.remove_repeats(edges)) == expected(rows, 100)
    assert repeats.remove_repeats(empty).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [
        (i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for i, n, spans, kept in expected(rows, 100)
    ]
    got = queries.QUERIES["op11_repeats"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
