"""Exact duplicates and their filters against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import common, exact_dedup, quotient_filter


def plain_copies(rows):
    """(id, keep id, size, body digest) of each row, and the number of rows that stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    return out, len(groups)


ODD = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \n"), (7, "a b"), (7, "a b"), (7, "ab "),
       (None, "a  b  "), (None, None), (8, "a b"), (9, "A b"), (10, "é ß"), (11, "éß"), (12, "x" * 300_000),
       (13, "x" * 299_999 + " x"), (-3, "a\tb\n")]


@pytest.mark.parametrize("bits, rows", [(64, 1_000_000), (64, 0), (3, 1_000_000), (1, 0)])
def test_copies(spark, documents, corpus, bits, rows, monkeypatch):
    """The same with fingerprints that collide, and with joins by shuffle throughout."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    found = exact_dedup.copies(docs, bits=bits).collect()
    truth, groups = plain_copies([*corpus, *ODD])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(truth)
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_what_stays_has_its_columns(documents, corpus):
    twice = documents.unionByName(documents)
    left = exact_dedup.without_copies(twice)
    assert left.columns == documents.columns
    truth, groups = plain_copies(corpus)
    rows = left.collect()
    assert len(rows) == groups
    assert Counter(r.doc_id for r in rows) == Counter(i for i, k, _, _ in set(truth) if i == k)


def test_ties_in_length_and_id_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "ab  c"), (1, "a b c"), (2, "abc d")],
                                 "doc_id int, text string")
    found = exact_dedup.copies(docs)
    assert dict(found.dtypes)["doc_id"] == dict(found.dtypes)["keep_id"] == "int"
    assert sorted((r.doc_id, r.group_size) for r in found.where("kept").collect()) == [(1, 3), (2, 1)]


def test_one_text_in_a_third_of_the_rows_and_no_rows(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text").repartition(7)
    found = exact_dedup.copies(docs)
    assert found.where("group_size = 1000 AND keep_id = 0").count() == 1000
    assert found.where("kept").count() == 2001
    assert exact_dedup.copies(docs.limit(0)).count() == exact_dedup.without_copies(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2 ** 64 - 1), st.sampled_from([1, 1, 2, 300])), max_size=40),
                max_size=5), st.sampled_from([0, 1, 8]), st.sampled_from([2 ** 64 - 1, 2 ** 64 - 2 ** 56, 255]))
def test_filters_merge_without_loss(parts, prefix_bits, mask):
    counts, held = Counter(), []
    for part in parts:
        values = [v & mask for v, n in part for _ in range(n)]
        counts.update(values)
        held.append(quotient_filter.by_range(np.array(values, np.uint64), prefix_bits))
    found = {}
    for prefix in {p for h in held for p in h}:
        whole = quotient_filter.merge([quotient_filter.unpacked(quotient_filter.packed(h[prefix]))
                                       for h in held if prefix in h], prefix_bits)
        values, n = quotient_filter.contents(quotient_filter.unpacked(quotient_filter.packed(whole)))
        assert (values[1:] > values[:-1]).all()
        found |= dict(zip(values.tolist(), n.tolist()))
    assert found == dict(counts)


def test_counts_take_several_slots():
    fingerprints = np.arange(4000, dtype=np.uint64)
    counts = np.full(4000, 1)
    counts[::50] = 10 ** 15
    made = quotient_filter.build(fingerprints, counts, 24)
    assert made.remainder_bits < 30 and made.counted.sum() == 2 * 80
    found, n = quotient_filter.contents(quotient_filter.unpacked(quotient_filter.packed(made)))
    assert (found == fingerprints).all() and (n == counts).all()
