"""The registered queries on the smallest tables, against SQL or plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import oracle_check
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quillsieve.llm import licenses, minhash, queries
from quillsieve.llm.bpe import WordBpe
from quillsieve.llm.fingerprints import chunk_list, containment, edited_chunks, gear_table
from quillsieve.llm.shingles import shingle_hashes


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees(spark, sf_dir, name):
    con = oracle_check.connect(sf_dir)
    assert not oracle_check.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_near_duplicates(spark, sf_dir, docs):
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in queries.QUERIES["op1_minhash"](spark, sf_dir).collect()}
    ids = docs.doc_id.tolist()
    first = [ids[i] for i in plain.near_classes(docs.text.tolist())]
    sizes = Counter(first)
    assert got == {i: (f, sizes[f], i == f) for i, f in zip(ids, first)}


def test_chains_and_large_buckets(spark):
    """Texts that change step by step, a large group of near copies, and groups that share half of their words."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    base = [rnd.choice(words) for _ in range(150)]
    for step in range(12):  # neighbours are alike, the ends are not
        texts.append(" ".join(base))
        base[step * 12] = f"changed{step}"
    base = [rnd.choice(words) for _ in range(200)]
    for i in range(80):
        copy = list(base)
        copy[rnd.randrange(200)] = f"only{i}"
        texts.append(" ".join(copy))
    shared = [rnd.choice(words) for _ in range(60)]
    for _ in range(40):
        texts.append(" ".join(shared + [rnd.choice(words) for _ in range(25)]))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(plain.near_classes(texts)))


def test_signatures_are_unbiased():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for k in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([20, 100, 400]))] * (1 + k % 4)
        other = base + base[: len(base) // 3]
        for _ in range(max(1, len(other) // 60)):
            other[rnd.randrange(len(other))] = "other"
        texts += [" ".join(base), " ".join(other)]
    registers = 1024
    found = minhash.signatures(*shingle_hashes(texts), len(texts), registers)
    off = []
    for k in range(0, len(texts), 2):
        sim = plain.similarity(plain.runs(texts[k]), plain.runs(texts[k + 1]))
        off.append(((found[k] == found[k + 1]).mean() - sim) / max(1e-9, (sim * (1 - sim) / registers) ** 0.5))
    assert abs(np.mean(off)) < 0.6 and np.std(off) < 1.6


def test_language(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op3_language"](spark, sf_dir).collect()}
    assert all(got[i].held_out == plain.held_out(i) for i in docs.doc_id)
    apart = [(got[i].lang_pred, lang) for i, lang in zip(docs.doc_id, docs.lang) if plain.held_out(i)]
    assert sum(a == b for a, b in apart) >= 0.97 * len(apart)


def test_language_does_not_read_its_answer(spark, sf_dir):
    """Predictions of held-out rows stay when their languages are hidden."""
    from pyspark.sql import functions as F

    from quillsieve.llm.langid import held_out, identify

    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = df.withColumn("lang", F.when(~held_out("doc_id"), F.col("lang")))
    rows = [sorted(map(tuple, identify(d).collect())) for d in (df, hidden)]
    assert rows[0] == rows[1]


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html

    for r in queries.QUERIES["op4_html_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        assert r.text == " ".join(t for t in texts if t) and r.n_chars == len(r.text)


def test_fingerprints(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    texts, gear = docs.text.tolist(), gear_table()
    for i, (doc_id, text) in enumerate(zip(docs.doc_id, texts)):
        n, follows = len(text) // 4, texts[(i + 1) % len(texts)]
        edited = text[: len(text) - n] + follows[:n]
        own, new, other = (Counter(chunk_list(t.encode(), gear)) for t in (text, edited, follows))
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(containment(own, new))
        assert r.near_next == pytest.approx(containment(own, other))


def test_chunks_resist_shifts():
    rnd, gear = random.Random(1), gear_table()
    text = " ".join(str(rnd.random()) for _ in range(3000)).encode()
    own = Counter(chunk_list(text, gear))
    assert containment(own, Counter(chunk_list(b"some words before " + text, gear))) > 0.97
    middle = text[:9000] + b"inserted" + text[9000:]
    assert containment(own, Counter(chunk_list(middle, gear))) > 0.95
    for same in (0, 1, 100, 5000, len(text)):
        changed = text[:same] + bytes(reversed(text[same:]))
        assert edited_chunks(chunk_list(text, gear), changed, same, gear) == chunk_list(changed, gear)
    assert sum(n for _, n in chunk_list(text, gear)) == len(text)


def test_tokens_equal_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordBpe(path)
    encode, rnd = own.encoder(), random.Random(2)
    ranges = [(1, 0x7F), (0x80, 0x24F), (0x300, 0x36F), (0x2000, 0x206F), (0x1F00, 0x1FFF), (0x1F600, 0x1F64F), (0xAC00, 0xAC20)]
    mixed = ["".join(chr(rnd.randint(*rnd.choice(ranges))) for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    fixed = ["", " ", "Σίσυφος ΣΑΣ", "<|endoftext|>a<|startoftext|>", "a\x1cb\x1f\x85c", "I'LL don't 'S's", "ab" * 4000, "!" * 999]
    texts = [*docs.text, *mixed, *fixed]
    for text, (found, decoded) in zip(texts, encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(found, "<u4").tolist() == ids
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_toxicity(spark, sf_dir):
    rows = queries.QUERIES["op9_toxicity"](spark, sf_dir.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").collect()}
    apart = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([s for s, t in apart if t == k] for k in (1, 0))
    assert sum(s < 0.5 for s in clean) >= 0.97 * len(clean)
    # a third of the toxic marks of this table are on texts without any sign of it
    assert sum(s >= 0.5 for s in toxic) >= 0.6 * len(toxic)
    assert all((r.score >= 0.5) == bool(r.predicted) for r in rows)


def test_grammar_weighs_clauses():
    from quillsieve.llm.toxicity import FEATURES, Machine

    machine = Machine({"idiot": 1.0}, {"moro": 1.0})
    kinds = {
        "what an idiot": "plain",
        "you are an idiot": "aimed",
        "an idiot you are": "aimed",
        "not an idiot": "negated",
        'he said "what an idiot"': "reported",
        "some moronic thing": "plain",
        "I will kill you": "threat",
    }
    for text, kind in kinds.items():
        found = dict(zip(FEATURES, machine.features(text)))
        assert found.pop(kind) > 0 and not any(found.values()), text
    assert not any(machine.features("nothing here. kill. you"))


def test_licenses(spark, sf_dir, docs):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "All rights reserved.": "all-rights-reserved",
    }
    want = Counter((i, n, lines[x]) for i, t in zip(docs.doc_id, docs.text) for n, x in enumerate(t.split("\n")) if x in lines)
    got = Counter((r.doc_id, r.line, r.licence) for r in queries.QUERIES["op2_licenses"](spark, sf_dir).collect())
    assert got == want
    known = licenses.templates()
    assert licenses.identify("Licensed under CC BY-NC-SA 4.0.", known)[0] == "CC-BY-NC-SA-4.0"
    assert licenses.identify("Licensed under the Apache License, Version 1.1.", known) is None


def test_shards_move_only_into_the_new_one(spark, sf_dir):
    rows = queries.QUERIES["op10_sharding"](spark, sf_dir.replace("0.001", "0.01")).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    assert any(r.grown_shard == 40 for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(40)) and max(counts.values()) < 3 * len(rows) / 40


def test_pipeline(spark, sf_dir, docs):
    """The stages against plain versions of what each one keeps."""
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    texts = dict(zip(docs.doc_id, docs.text))
    lettered = [i for i in sorted(texts) if re.search(r"[^\W\d_]", texts[i])]
    kept = {}
    for i in lettered:
        kept[texts[i]] = i  # the largest id stays
    ids = sorted(kept.values())
    first = plain.near_classes([texts[i] for i in ids])
    ids = [i for n, i in enumerate(ids) if first[n] == n]
    source = dict(zip(docs.doc_id, docs.source))
    names = sorted(set(source[i] for i in ids))
    sizes = [sum(len(texts[i].split()) for i in ids if source[i] == s) for s in names]
    targets = plain.water_fill(sizes, [(3, 1, 2)[n % 3] for n in range(len(names))])
    got = Counter(r.doc_id for r in rows)
    assert set(got) <= set(ids) and max(got.values()) <= 2
    for s, size, target in zip(names, sizes, targets):
        own = {i: len(texts[i].split()) for i in ids if source[i] == s}
        assert abs(sum(got[i] * n for i, n in own.items()) - target) <= 0.5 * max(own.values()) + 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        found = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
