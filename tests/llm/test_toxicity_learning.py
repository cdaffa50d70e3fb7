"""Insults are learned from distinct texts, also if some of them are marked clean."""

from __future__ import annotations

import plain

from quillsieve.llm.toxicity import learn_insults, score_toxicity


def own(kind: str, i: int) -> str:
    """A word of four letters that no other text has."""
    return "".join([chr(97 + i // 26**k % 26) for k in range(3)]) + kind


def test_copies_of_a_clean_text_count_once(spark):
    ids = iter([i for i in range(20_000) if not plain.held_out(i)])
    toxic = [(next(ids), f"some idiot {own('a', i)} {own('b', i)} {own('c', i)}", 1) for i in range(60)]
    clean = [(next(ids), f"some thing {own('d', i)} {own('e', i)} {own('f', i)}", 0) for i in range(300)]
    copies = [(next(ids), "they read the word idiot aloud", 0) for _ in range(2_000)]
    rows = toxic + clean + copies
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id bigint, toxic int")
    scores = {r.doc_id: r.score for r in score_toxicity(df, labels).collect()}
    assert all(scores[i] >= 0.5 for i, _, _ in toxic) and all(scores[i] < 0.5 for i, _, _ in clean)


def test_label_noise(spark):
    rows = [(1, f"some idiot {own('a', i)} {own('b', i)}") for i in range(60)] + [(1, f"some dolt {own('a', i)} {own('c', i)}") for i in range(60)]
    rows += [(0, f"some dolt {own('d', i)} {own('e', i)}") for i in range(12)] + [(0, f"some thing {own('f', i)} {own('g', i)}") for i in range(500)]
    insults, stems = learn_insults(spark.createDataFrame(rows, "label int, text string"))
    assert set(insults) == {"idiot", "dolt"} and insults["idiot"] > insults["dolt"] > 0
