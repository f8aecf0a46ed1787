"""Formulas over many points at once, against rationals."""

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from attestry.operators import formula


def _tree(rng, depth):
    if not depth or rng.random() < 0.2:
        return rng.choice(["x", "x", Fraction(rng.randrange(10)), Fraction(rng.randrange(1000), 10 ** rng.randrange(4))])
    op = rng.choice(["+", "-", "*", "/", "neg", "abs", "pow"])
    a = _tree(rng, depth - 1)
    if op in ("neg", "abs"):
        return (op, a)
    return ("pow", a, rng.randrange(-3, 5)) if op == "pow" else (op, a, _tree(rng, depth - 1))


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_rationals(seed):
    rng, kinds = random.Random(seed), set()
    for _ in range(600):
        tree, scale, y_scale = _tree(rng, rng.randrange(5)), rng.randrange(7), rng.randrange(13)
        units = np.array([rng.randrange(-(10**k), 10**k + 1) for k in [rng.randrange(1, rng.choice([3, 7, 18]))] for _ in range(12)] + [0, 1, -1], np.int64)
        try:
            batch = formula.Batch(tree, units, scale, y_scale)
        except formula._Wide:
            kinds.add("wide")
            continue
        got = batch.rounded()
        kinds.add(got.dtype.kind)
        for u, y, undefined in zip(units.tolist(), got.tolist(), batch.undefined.tolist(), strict=True):
            try:
                want = formula.quantised(formula.value(tree, {"x": Fraction(u, 10**scale)}), y_scale)
            except formula.Refused as e:
                assert e.check == "formula.values_defined" and undefined
                kinds.add("undefined")
                continue
            assert not undefined and y == want, (tree, u, scale, y_scale)
    assert {"wide", "i", "O", "undefined"} <= kinds


def test_evaluation_of_mixed_formulas(spark):
    """Small, wide and refused formulas, points beyond machine integers, values beyond 38 digits, nulls."""
    texts = ["x", "x**2 - 1/3", "1/x", "x**20", "2**64 * x", "x +", "sin(x)", "x*1" + "0" * 30, "((x**16)**16)**16", None]
    rows = [(k, f, k % 5 if f else None) for k, f in enumerate(texts)]
    formulas = spark.createDataFrame(rows, "formula_id long, formula string, y_scale int")
    xs = [Decimal("0"), Decimal("1.5"), Decimal("-2.000001"), Decimal("12345678901234567890123.25"), None]
    points = spark.createDataFrame([(k, i, x) for k in range(len(texts)) for i, x in enumerate(xs)], "formula_id long, i int, x decimal(38,12)")
    got = {(r.formula_id, r.i): r for r in formula.evaluated(points, formulas).collect()}
    assert set(got) == {(k, i) for k in range(len(texts) - 1) for i in range(len(xs) - 1)}
    for (k, i), r in got.items():
        try:
            want = Fraction(formula.quantised(formula.value(formula.parse(texts[k]), {"x": Fraction(xs[i])}), rows[k][2]), 10 ** rows[k][2])
        except formula.Refused as e:
            assert (r.y, r.status) == (None, e.check)
            continue
        assert r.status == "ok"
        assert r.y is None if abs(want) >= 10**26 else Fraction(r.y) == want
