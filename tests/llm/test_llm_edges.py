"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import plain
import public_tokenizers
import pytest
from llm_rows import EDGES, LONG
from tokenizers import Tokenizer

from quillsieve.llm.bpe import encode_documents
from quillsieve.llm.exact_dedup import exact_groups
from quillsieve.llm.fingerprints import chunk_list, containment, fingerprint_documents, gear_table
from quillsieve.llm.htmltext import extract_pages
from quillsieve.llm.langid import identify
from quillsieve.llm.licenses import scan_licenses
from quillsieve.llm.minhash import near_duplicates
from quillsieve.llm.mixing import mix_sources
from quillsieve.llm.sharding import assign_shards
from quillsieve.llm.toxicity import score_toxicity

TOKENS = public_tokenizers.path("word_bpe_49k.json")
IDS = Counter(r[0] for r in EDGES)


def labels(spark, rows=((1, 0), (7, 1), (7, 0), (None, 1), (5, None), (6, 2))):
    return spark.createDataFrame(list(rows), "doc_id bigint, toxic int")


OPERATORS = {
    "near": near_duplicates,
    "language": identify,
    "fingerprints": fingerprint_documents,
    "tokens": lambda df: encode_documents(df, TOKENS),
    "mix": mix_sources,
    "exact": exact_groups,
    "toxicity": lambda df: score_toxicity(df, labels(df.sparkSession)),
    "shards": assign_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(edges, empty, name):
    assert Counter(r[0] for r in OPERATORS[name](edges).collect()) == IDS
    assert OPERATORS[name](empty).collect() == []


def test_near(edges):
    found = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_duplicates(edges).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (5, 5, 2, True), (6, 5, 2, False)} <= found
    assert {(3, 3, 2, True), (4, 3, 2, False)} <= found  # a null text is an empty one
    assert (9, 9, 1, True) in found and (7, 7, 2, True) in found and (None, None, 1, True) in found


def test_language(edges):
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(edges).collect()}
    assert all(found[i] == ("und", 0.0) for i in (3, 4, 8, 9))
    assert found[1][0] == "en" and all(0 <= s <= 1 for _, s in found.values())


def test_fingerprints(edges):
    rows = fingerprint_documents(edges).collect()
    gear = gear_table()
    ordered = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    after = {r[0]: ordered[(i + 1) % len(ordered)][1] or "" for i, r in enumerate(ordered)}
    for r in rows:
        text = next(e[1] or "" for e in EDGES if e[0] == r.doc_id)
        n = len(text) // 4
        follows = {after[r.doc_id], text} if r.doc_id == 7 else {after[r.doc_id]}
        assert r.n_chars == len(text)
        assert r.edited in {text[: len(text) - n] + f[:n] for f in follows}
        own, new = (Counter(chunk_list(t.encode(), gear)) for t in (text, r.edited))
        assert r.near_edited == pytest.approx(containment(own, new))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint != ""
    assert by_id[3].fingerprint == by_id[4].fingerprint == ""
    assert by_id[3].near_next == 1.0 and by_id[1].near_next == 1.0 and by_id[5].near_next > 0.9
    assert len(chunk_list(LONG.encode(), gear)) > 100


def test_tokens(edges):
    library = Tokenizer.from_file(TOKENS)
    for r in encode_documents(edges, TOKENS).collect():
        text = next(e[1] or "" for e in EDGES if e[0] == r.doc_id)
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] == ids
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_mix(edges):
    rows = mix_sources(edges).collect()
    sizes = Counter()
    for e in EDGES:
        sizes[e[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", e[1] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(names, plain.water_fill([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    source = {e[0]: e[3] for e in EDGES}
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.whole * r.size + r.part
        taken[source[r.doc_id]] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5 + 1e-9
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_sources(edges.repartition(5)).collect()), key=repr)


def test_exact(edges):
    rows = [tuple(r) for r in exact_groups(edges).collect()]
    distinct = [(e[0], e[1]) for i, e in enumerate(EDGES) if e not in EDGES[:i]]
    want = [(i, k, n + (i == 7), keep, h) for i, k, n, keep, h in plain.exact(distinct)]
    want.append((7, 7, 2, False, hashlib.sha256(EDGES[6][1].encode()).hexdigest()))
    assert Counter(rows) == Counter(want)


def test_toxicity(edges, spark):
    found = {r.doc_id: r.score for r in score_toxicity(edges, labels(spark)).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[3] == found[4]
    none = score_toxicity(edges, labels(spark, [])).collect()
    assert all(0 <= r.score <= 1 for r in none)


def test_shards(edges):
    rows = assign_shards(edges, shards=40).collect()
    texts = {e[0]: e[1] or "" for e in EDGES}
    slots: dict[int, list[int]] = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.shard == plain.tree_shard(key, [1.0] * 40) and r.grown_shard == plain.tree_shard(key, [1.0] * 41)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_licenses(spark, empty):
    rows = [
        (1, "Intro.\nReleased under the MIT License.\nAll rights reserved."),
        (2, None),
        (3, ""),
        (4, "x " * 50_000 + "licensed under CC BY-NC 4.0."),
        (4, "x " * 50_000 + "licensed under CC BY-NC 4.0."),
        (None, "Licensed under the Apache License, Version 1.1."),
        (5, "The driver lost his driving licence."),
        (6, "This work is licenced under the GNU General Public License, version 3."),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, line string, licence string")
    found = [(r.doc_id, r.line, r.licence, r.differs) for r in scan_licenses(df).collect()]
    assert Counter(found) == Counter(
        [
            (1, 1, "MIT", ""),
            (1, 2, "all-rights-reserved", ""),
            (4, 0, "CC-BY-NC-4.0", ""),
            (4, 0, "CC-BY-NC-4.0", ""),
            (6, 0, "GPL-3.0", "-licensed +licenced"),
        ]
    )
    assert scan_licenses(empty).collect() == []


def test_pages(spark):
    long = "<p>" + "One sentence, and another one. " * 20_000 + "</p>"
    rows = [
        (1, "u", "<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Some text,\n with <b>bold</b> &amp; more.</p></article>"),
        (1, "u", "<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Some text,\n with <b>bold</b> &amp; more.</p></article>"),
        (2, None, None),
        (3, "v", ""),
        (None, "w", "<div class=cookie>We use cookies.</div><!-- never ends <p>x"),
        (4, "z", f"<body>{long}<div class='comments'><p>First!</p></div></body>"),
        (5, "y", "<p title='a>b'>1 < 2</p><script>var t = '<p>no</p>';</script><p>two</p>"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, text string")
    found = Counter((r.page_id, r.url, r.text) for r in extract_pages(df).collect())
    article = "Title Some text, with bold & more."
    assert found == Counter(
        [
            (1, "u", article),
            (1, "u", article),
            (2, None, ""),
            (3, "v", ""),
            (None, "w", ""),
            (4, "z", ("One sentence, and another one. " * 20_000).strip()),
            (5, "y", "1 < 2 two"),
        ]
    )
    assert extract_pages(df.where("false")).collect() == []
