"""Whitening against a plain version in numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tallymill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, n int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=4):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1][:, :components]
    z = (x - sums / n) @ vectors / np.sqrt(values[:components])
    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [i for i, _ in kept], n, deviation, z, (values / values.sum())[:components]


def rows_of(number, width, seed=5):
    rng = random.Random(seed)
    spread = [1 + 3 / (k + 1) for k in range(width)]
    return [(i, [rng.gauss(k * 0.01, spread[k]) for k in range(width)]) for i in range(number)]


@pytest.mark.parametrize("width, block_rows", [(7, 8192), (7, 16), (3, 50)])
def test_rows_are_whitened(spark, width, block_rows):
    rows = rows_of(130, width)
    rows += [(500 + i, rows[3][1]) for i in range(70)]  # one vector in a third of the rows
    rows += [(900, None), (901, []), (902, [None] * width), (903, [float("nan")] * width),
             (904, [1.0] * (width - 1) + [float("inf")]), (None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1])]
    found = whitening.whitened(table(spark, rows), block_rows=block_rows)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids, n, deviation, z, explained = plain(rows)
    got = found.collect()
    signs = {}
    for r in got:  # either sign, the same for all rows
        if r.vec_id == 0:
            signs[r.component] = math.copysign(1, r.whitened * z[0][r.component - 1])
    assert len(got) == len(ids) * min(4, width) and {r.n for r in got} == {n}
    order = lambda t: tuple((v is None, v or 0) for v in t)
    truth = sorted(((i, k + 1, round(float(z[at][k] * signs[k + 1]), 9), int(deviation[at]))
                    for at, i in enumerate(ids) for k in range(min(4, width))), key=order)
    seen = sorted(((r.vec_id, r.component, round(r.whitened, 9), r.deviation) for r in got), key=order)
    assert [t[:2] + t[3:] for t in truth] == [t[:2] + t[3:] for t in seen]
    assert np.allclose([t[2] for t in truth], [t[2] for t in seen], atol=1e-7)
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[k + 1] for k in range(len(shares))], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_components_without_variance(spark):
    flat = [(i, [float(i), 2.0, 2.0 * i]) for i in range(20)]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(table(spark, flat)).collect()}
    assert len(got) == 60 and got[3, 2].whitened is None and got[3, 3].whitened is None
    assert got[3, 1].whitened is not None and got[3, 1].identity_error < 1e-9
    assert abs(got[3, 1].explained - 1) < 1e-9 and got[3, 2].explained < 1e-9
    same = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in same} == {
        (None, None, None, 0, 1)}


def test_nothing_usable_and_several_lengths(spark):
    empty = whitening.whitened(table(spark, [(1, None), (2, [])]))
    assert empty.count() == 0
    assert empty.dtypes == whitening.whitened(table(spark, rows_of(9, 2))).dtypes
    with pytest.raises(ValueError, match="2 to 3 numbers"):
        whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])]))


def test_large_numbers_are_summed_exactly(spark):
    rows = spark.createDataFrame([([2 ** 62 + i, -i],) for i in range(12)], "x array<long>")
    assert whitening._sums(rows) == (12, [12 * 2 ** 62 + 66, -66], 2, 2)
