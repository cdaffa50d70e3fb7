"""Words and their runs against a plain tokenizer, for any script."""

from __future__ import annotations

from collections import Counter

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve.llm.shingles import Words, shingle_hashes

CHINESE = "今天天气很好，我们去公园散步。孩子们在草地上玩耍，老人坐在树下聊天。"
MIXED = st.text(alphabet=st.sampled_from(list("abZ9 \n.’'“”«»…— éİß天气かカไทยั́ไमिا一①")), max_size=60)


def likeness(a: str, b: str) -> float:
    hashes, text = shingle_hashes([a, b])
    left, right = (Counter(hashes[text == i].tolist()) for i in (0, 1))
    return plain.similarity(left, right)


@pytest.mark.parametrize(
    "a, b",
    [
        ("\"It's late,\" she said, and closed the old door.", "“It’s late,” she said, and closed the old door."),
        ("Il dit « oui » puis il part vite demain", "Il dit « oui » puis il part vite demain"),
        ("one two three - four five six", "one two three—four five six…"),
    ],
)
def test_marks_part_words(a, b):
    assert likeness(a, b) == 1.0


def test_scripts_without_spaces():
    assert len(Words([CHINESE]).hashes) == 6 + 7 + 9 + 8
    assert likeness(CHINESE, CHINESE[:-4] + "。") > 0.8
    assert likeness("ภาษาไทยไม่มีช่องว่าง", "ภาษาไทยไม่มีช่องว่างเลย") > 0.7


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, max_size=5))
def test_words_are_those_of_the_plain_rule(texts):
    words = Words(texts)
    found = [plain.WORD.findall(t.lower()) for t in texts]
    assert words.count.tolist() == [len(f) for f in found]
    names: dict[int, str] = {}
    for value, word in zip(words.hashes.tolist(), [w for f in found for w in f], strict=True):
        assert names.setdefault(value, word) == word
    assert len(set(names.values())) == len(names)


def test_runs_of_no_words():
    hashes, text = shingle_hashes(["", "…", "\ud800 a"])
    assert text.tolist() == [2]
    assert hashes.dtype == np.uint64
