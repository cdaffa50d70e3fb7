"""Alignment of two tokenizers, against whole texts through both libraries."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillsieve.llm import alignment, queries
from quillsieve.llm.bpe import byte_letters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
HARD = [
    "two  spaces   three", " lead", "trail ", "trail  ", " ", "  ", "\n x", "a\n b\t c", "tab\tx  y　 z", "a▁b", "▁",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 \x01\x02", "café üß \U0001f600\U0001f600 中文 字", "it's we'll 12 345 !?",
    "x" * 3000, " " * 50 + "y", "é́ ́x", "ﬁ Å", "\x1c \x1d a", "  b\u0085 c", "a' b'll  'll",
]


def plain(rows):
    """By both libraries over whole texts."""
    a_lib = Tokenizer.from_file(PATHS[0])
    a_lib.encode_special_tokens = True
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    token_a = {i: bytes(byte[c] for c in t) for t, i in a_lib.get_vocab().items() if t != "<|endoftext|>"}
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def token_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    out, all_links, counts = [], [], Counter()
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if b"".join(token_a[i] for i in a) != data or b"".join(map(token_b, b)) != data:
            out.append((doc_id, 0, 0, 0, 0, "")), all_links.append([])
            continue
        ends_a, ends_b, at = [], [], 0
        for i in a:
            ends_a.append(at := at + len(token_a[i]))
        at = 0
        for i in b:
            ends_b.append(at := at + len(token_b(i)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate([(a, ends_a), (b, ends_b)]):
            for i, end in zip(ids, ends):
                groups[bisect_left(cuts, end)][side].append(str(i))
        groups = [",".join(own_a) + "|" + ",".join(own_b) for _, (own_a, own_b) in sorted(groups.items())]
        starts_a, starts_b = [0, *ends_a], [0, *ends_b]
        links, low = [], 0
        for i, s, e in zip(a, starts_a, ends_a):
            while ends_b[low] <= s:
                low += 1
            j = low
            while j < len(b) and starts_b[j] < e:
                links.append((i, b[j]))
                j += 1
        counts.update(links)
        all_links.append(links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(groups), len(links), sha))
    most = Counter()
    for (_, b_id), n in counts.items():
        most[b_id] = max(most[b_id], n)
    return sorted(
        (
            (*o[:5], sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), o[5])
            for o, links in zip(out, all_links)
        ),
        key=str,
    ), counts


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("heavy", [0, 40, alignment.HEAVY])
def test_hard_texts(spark, edges, heavy):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(r.doc_id, r.text) for r in edges.collect()]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, n bigint, pair string, `row` int")
    docs, pairs = alignment.align_documents(df.repartition(3), *PATHS, heavy=heavy)
    expected, counts = plain(rows)
    assert sorted(map(tuple, docs.select(*COLUMNS).collect()), key=str) == expected
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op13_alignment"](spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)[0]


def test_empty(spark, empty):
    docs, pairs = alignment.align_documents(empty, *PATHS)
    assert docs.count() == 0 and pairs.count() == 0
