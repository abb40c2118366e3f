"""Hard negatives against a plain version."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key long, x int, id string, width int, windows int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "i", 3, 4) for r in rows], SCHEMA).repartition(parts)


def plain(rows, positives=5, negatives=3):
    used = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows
            if v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for at, (anchor, x, label) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), i, other == label) for k, (i, y, other) in enumerate(used)
                  if k != at and len(x) == len(y)]
        scored.sort(key=lambda t: (-t[0], last(t[1])))
        for p, i, _ in [t for t in scored if t[2]][:positives]:
            inside = [t for t in scored if not t[2] and 50 * p <= 100 * t[0] <= 95 * p][:negatives]
            out.update((anchor, i, k + 1, j, p, s) for k, (s, j, _) in enumerate(inside))
    return out


def rows_of(number, width, seed, scale=1.0, grid=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    out = []
    for i in range(number):
        at = [scale * (c + rng.gauss(0, 0.7)) for c in rng.choice(centres)]
        out.append((i, [round(c * grid) / grid for c in at] if grid else at, rng.choice([0, 1, 2])))
    return out


ODD = [(None, [0.5] * 6, 1), (None, [0.6] * 6, 2), (50, [1.0] * 6, None), (100, None, 1), (150, [None] * 6, 1),
       (200, [float("nan")] * 6, 1), (250, [1.0] * 5 + [float("inf")], 1), (50, [0.4] * 6, 1), (50, [0.4] * 6, 1),
       (300, [1.0, 2.0], 1), (301, [1.0, 2.5], 1), (302, [1.0, 1.2], 2), (350, [], 1), (351, [], 1), (352, [], 2),
       (-50, [0.0] * 6, 0), (400, [-3.0] * 6, 9)]


@pytest.mark.parametrize("grid, block_rows, step, shares", [
    (None, 4096, 8, (16, 64, 4, 4096)), (2, 4096, 2, (3, 1, 2, 1)), (None, 20, 1, (1, 2, 1, 5)), (2, 7, 4, (2, 9, 3, 2))])
def test_mined_rows(spark, grid, block_rows, step, shares, monkeypatch):
    """Ties (a coarse grid), small blocks, stripes and groups, and odd rows."""
    for name, value in zip(("STRIPES", "STRIPE_BLOCKS", "GROUPS", "GROUP_ANCHORS"), shares):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(420, 6, 3, grid=grid)
    rows += [(1000 + i, rows[8][1], rows[8][2]) for i in range(220)]  # one vector in a third of the rows
    rows += ODD
    found = hard_negatives.mine(table(spark, rows), F.col("id") % 50 == 0, block_rows=block_rows, step=step)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    truth = plain(rows)
    assert sum(truth.values()) > 80
    assert Counter(tuple(r) for r in found.collect()) == truth


def test_other_numbers_of_rows_and_large_components(spark):
    rows = [(i, [c * 1e6 for c in v], label) for i, v, label in rows_of(120, 5, 11)]
    found = hard_negatives.mine(table(spark, rows), F.col("id") % 50 == 0, positives=2, negatives=40)
    assert Counter(tuple(r) for r in found.collect()) == plain(rows, 2, 40)


def test_nothing_to_mine(spark):
    alone = [(50, [1.0, 1.0], 1), (51, [1.0, 1.0], 2), (52, [0.7, 0.7], 2)]
    assert hard_negatives.mine(table(spark, alone), F.col("id") % 50 == 0).count() == 0
    empty = hard_negatives.mine(table(spark, alone).limit(0), F.col("id") % 50 == 0)
    assert empty.count() == 0
    assert [t for _, t in empty.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_a_scan_narrows_its_candidates():
    """Most rows leave before the last dimension is read."""
    rng = np.random.default_rng(2)
    cells = np.floor(rng.normal(0, 30, (64, 2000)))
    anchor = np.floor(rng.normal(0, 1, 64) * 200 / (1 + np.arange(64)))
    sizes = []

    def keep(_, low, high):
        stays = high >= np.sort(low)[-5]
        sizes.append(int(stays.sum()))
        return stays

    places, scores = hard_negatives.scan(anchor, cells, cells.min(axis=1), cells.max(axis=1),
                                         np.ones(2000, bool), keep)
    whole = anchor @ cells
    assert set(np.argsort(-whole)[:5]) <= set(places) and (scores == whole[places]).all()
    assert sizes == sorted(sizes, reverse=True) and sizes[4] < 200
