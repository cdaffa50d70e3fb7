"""Repair of conversations, against all edit sequences and over any cut into blocks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillsieve.llm import conversations as cv

ORDER = re.compile(r"(s?(ua)+)?")


def every_repair(cells, inserts=2):
    """All edits with at most ``inserts`` insertions in a row, as (cost, audit) where the result is in order."""
    found = []

    def walk(at, cost, audit, roles, run):
        if at == len(cells) and ORDER.fullmatch(roles):
            found.append((cost, audit))
        if run < inserts:
            for role in "ua":
                walk(at, cost + 3, audit + "I", roles + role, run + 1)
        if at < len(cells):
            initial, fault = cells[at]
            walk(at + 1, cost + 4, audit + "D", roles, 0)
            if fault not in (cv.BLANK, cv.DUPLICATE):
                more = 3 if fault == cv.BROKEN else 0
                walk(at + 1, cost + more, audit + "K", roles + (initial or "x"), 0)
                for role in "ua":
                    walk(at + 1, cost + 3 + more, audit + "R", roles + role, 0)

    walk(0, 0, "", "", 0)
    return min(found)


def test_against_all_edits():
    rnd = random.Random(1)
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in range(4)]
    for n in range(4):
        for cells in itertools.product([("s", 0), ("u", 0), ("a", 0), ("u", 3), ("", 0), ("a", 1)], repeat=n):
            assert cv.cheapest(cells) == every_repair(cells), cells
    for _ in range(4):
        cells = [rnd.choice(kinds) for _ in range(4)]
        assert cv.cheapest(cells) == every_repair(cells), cells


def test_bounds_never_exceed_the_cost():
    rnd = random.Random(2)
    for _ in range(200):
        cells = [(rnd.choice(["s", "u", "a", ""]), rnd.randrange(4)) for _ in range(rnd.randrange(9))]
        bounds = cv.suffix_bounds(cells, cv.ENDS)
        for at in range(len(cells) + 1):
            for state in cv.STATES:
                assert bounds[at][state] <= cv.cheapest(cells[at:], state)[0]


def test_a_long_conversation():
    cells = [("u", 0)] * 4000
    cost, audit = cv.cheapest(cells)
    assert cost == 6000 and len(audit) == 4000


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, part string, open string"


def plain(rows):
    """Results of the given (conv_id, turn, role, text) rows, each conversation by itself."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, cells = set(), []
        for _, role, text in own:
            cells.append((role[:1] if role[:1] in "sua" else "", cv.first_fault(role, text, seen)))
        cost, audit = cv.cheapest(cells)
        text = "\n".join(f"{r}:{t}" for r, t in cv.apply(audit, [(r, t) for _, r, t in own]))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(f == k for _, f in cells) for k in (1, 2, 3)],
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text,
        )
    return out


def collected(found):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256, r.repaired)
        for r in found.collect()
    }


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_any_cut_into_blocks(spark, block):
    rnd = random.Random(block)
    texts = ["Yes.", "no", "", " \t", "Is it? ", None, "a b c!", "über\n"]
    rows = [
        (rnd.choice([None, 1, 2, 3, 3, 3, 3, 4]), rnd.choice([None, *range(60)]), rnd.choice(["user", "assistant"] * 4 + ["system", None, ""]),
         rnd.choice(texts) if rnd.random() < 0.4 else f"text {i}.")
        for i in range(400)
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    assert collected(cv.repair_conversations(df, with_text=True, block=block)) == plain(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_conversations(empty).count() == 0
    rows = [(i, 0, "user", f"text {i}.") for i in range(30)] + [(7, 1, "assistant", "word " * 200_000 + ".")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    # conversations without messages are named all the same
    found = cv.repair_conversations(df, missing=F.col("conv_id") % 2 == 0, with_text=True).collect()
    assert len(found) == 30
    nothing = {(r.gaps, r.blank, r.cost, r.audit, r.repaired, r.repaired_sha256) for r in found if r.conv_id % 2 == 0}
    assert nothing == {(0, 0, 0, "", "", hashlib.sha256(b"").hexdigest())}
    assert {r.audit for r in found if r.conv_id % 2 and r.conv_id != 7} == {"KI"}
    assert [r.audit for r in found if r.conv_id == 7] == ["KK"]
