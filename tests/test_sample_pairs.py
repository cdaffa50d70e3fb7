"""Draws of matrix cells when cells are missing."""

from __future__ import annotations

from quillsieve.operators.selection import sample_pairs


def test_every_draw_gives_a_row(spark):
    cells = [(r, c, r * 10.0 + c) for r in range(5) for c in range(4) if (r + c) % 2 == 0]
    weights = spark.createDataFrame(cells, "row bigint, col bigint, w double")
    scales = spark.createDataFrame([(c, float(c)) for c in range(3)], "col bigint, s double")
    found = sample_pairs(weights, scales, 15).collect()
    assert sorted(r.draw for r in found) == list(range(15))
    known = {(r, c): w for r, c, w in cells}
    assert all(r.w == known.get((r.row, r.col)) for r in found)
    assert all(r.s == (float(r.col) if r.col < 3 else None) for r in found)
    assert any(r.w is None for r in found)


def test_an_empty_matrix_gives_nothing(spark):
    weights = spark.createDataFrame([], "row bigint, col bigint, w double")
    scales = spark.createDataFrame([], "col bigint, s double")
    assert sample_pairs(weights, scales, 15).count() == 0
