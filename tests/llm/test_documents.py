"""Operators over documents against plain versions, with odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tallymill.llm import (bpe, common, decontaminate, ngram_join, quality_rules, substring_dedup,
                           token_counts, toxicity, vocabulary)
from tallymill.llm.components import components


def test_quality_measures_and_verdicts(documents, corpus):
    rows = quality_rules.judged(documents, ["doc_id", "source"]).collect()
    names = [*quality_rules.MEASURES, "base_failed"]
    found = Counter((r.doc_id, *(r[c] for c in names)) for r in rows)
    assert found == Counter((i, *(brute.measures(t)[c] for c in names)) for i, t in corpus)
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_a_host_of_failures_takes_its_good_documents_along(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good, f"fine{i % 4}") for i in range(40)] + [
        (100 + i, "bad", "junk") for i in range(30)] + [(200, good, "junk"), (201, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judged(df, ["doc_id"]).where("kept").collect()}
    assert kept == {*range(40), 201}
    assert {r.doc_id for r in quality_rules.passing(df).collect()} == kept
    rates = {r.source: r.rate for r in quality_rules.host_rates(quality_rules.measured(df)).collect()}
    assert 0.5 < rates["junk"] < 30 / 31 and 0 < rates[None] < 0.5


def test_leaks(spark, documents, corpus):
    rng = random.Random(3)
    long_text = dict(corpus)[124].split()
    items = [(0, " ".join(long_text[100:130])), (1, " ".join(long_text[9:12])), (2, prose(rng, 30)),
             (3, None), (4, ""), (5, "ONE two"), (6, "one"),
             (7, " ".join(long_text[500:540] + ["new", "words", "at", "end"])),
             (8, " ".join(long_text[700:710] + ["x"] * 9)), (0, " ".join(long_text[100:130]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(documents, table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(corpus, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found}) and (124, 7) in {
        (r.doc_id, r.item_id) for r in found}
    left = {r.doc_id for r in decontaminate.clean(documents, table).collect()}
    assert left == {i for i, _ in corpus} - {r.doc_id for r in found}


@pytest.mark.parametrize("size, percent, block, rows", [
    (4, 85, 400_000, 1_000_000), (4, 85, 300, 0), (5, 80, 300, 1_000_000)])
def test_joined_documents(documents, corpus, size, percent, block, rows, monkeypatch):
    """The same with small blocks, and with joins by shuffle throughout."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    found = ngram_join.linked_documents(documents, size, percent).collect()
    sets = {i: brute.shingles(t, size) for i, t in corpus if i is not None}
    truth = brute.components(sets, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {
        (i, len(sets[i]), truth[i]) for i in sets}
    assert [r.component_id for r in found if r.doc_id is None] == [None, None]
    assert len(found) == len(corpus)


def test_one_of_each_group_stays(documents, corpus):
    kept = ngram_join.one_of_each(documents.union(documents.where("doc_id = 50")))
    truth = brute.components({i: brute.shingles(t, 4) for i, t in corpus if i is not None}, 85)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(truth.values()))
    assert kept.columns == documents.columns and kept.where("doc_id is null").count() == 2


def test_repeated_ids_do_not_break_the_join(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (1, "other words here and more of them"), (2, text), (3, None)]
    found = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [
        (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_rows_that_share_an_id_are_judged_each_by_its_own_text(spark):
    first, second, third, fourth = (" ".join(f"{c}{i}" for i in range(30)) for c in "pqrs")
    rows = [(0, first), (1, first), (1, second), (1, second.upper()), (1, second), (5, second), (6, third),
            (7, fourth), (7, third), (8, ""), (8, None), (8, ""), (None, first), (None, fourth)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r.doc_id, r.text and r.text.lower()) for r in ngram_join.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(0, first), (1, second), (6, third), (7, fourth), (8, ""), (8, None),
                           (None, first), (None, fourth)], key=repr)
    items = spark.createDataFrame([(1, first)], "item_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()), key=repr)
    assert left == sorted((r for r in rows if r[1] != first), key=repr)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in components(df).collect()}
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in links)}


def test_links_that_differ_at_each_computation_lose_no_node(spark):
    """A star around a random root of each group, as a forest of rows in any order may be."""

    def run(batches):
        for batch in batches:
            edges = []
            for group in batch.column(0).to_pylist():
                root = random.SystemRandom().randrange(20)
                edges += [(group * 20 + k, group * 20 + root) for k in range(20) if k != root]
            a, b = zip(*edges)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    links = spark.range(40, numPartitions=4).mapInArrow(run, "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {
        i: i // 20 * 20 for i in range(800)}


def test_links_of_a_part_do_not_depend_on_the_order_of_its_rows():
    common, rng = list(range(30)), random.Random(4)
    rows = [(50 - i, [*common, 100 + i], 31, i % 2, True, 0, 1) for i in range(12)]
    names = ["rep", "shingles", "n", "block", "open", "b1", "b2"]
    found = set()
    for _ in range(6):
        rng.shuffle(rows)
        part = pa.table(dict(zip(names, zip(*rows))))
        links = ngram_join.part_links(part, 85).to_pydict()
        found.add(tuple(sorted(zip(links["a"], links["b"]))))
    assert len(found) == 1 and len({x for e in found.pop() for x in e}) == 12


def test_forest_joins_what_links():
    sets = [[1, 2, 3, 4], [1, 2, 3, 5], [9, 10], [1, 2, 3, 4, 6], [9, 10, 11]]
    lists = pa.array(sets, pa.list_(pa.int64()))
    n = np.array([len(s) for s in sets])
    a, b = ngram_join.forest(lists, n, np.arange(5), np.arange(5), 60)
    assert list(zip(a, b)) == [(1, 0), (3, 0), (4, 2)]


@pytest.mark.parametrize("tile, dense", [(1 << 20, 64), (37, 64), (200, 4), (200, 10 ** 9), (1 << 20, 0)])
def test_forest_of_tiles_against_all_pairs(tile, dense, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rng = random.Random(tile)
    for _ in range(12):
        base = [rng.randrange(60) for _ in range(30)]
        sets = {i: frozenset((base if rng.random() < 0.6 else [rng.randrange(60) for _ in range(30)])[
            :rng.randrange(1, 30)] + [rng.randrange(2000) for _ in range(rng.randrange(6))]) for i in range(40)}
        arrays = pa.array([sorted(x) for x in sets.values()], pa.list_(pa.int64()))
        sizes = np.array([len(x) for x in sets.values()])
        a, b = ngram_join.forest(arrays, sizes, np.arange(40), np.arange(40), 60)
        wanted = brute.components(sets, 60)
        label = list(range(40))
        for x, y in sorted(zip(a.tolist(), b.tolist())):
            assert y < x
            label[x] = label[y]
        assert label == [wanted[i] for i in range(40)]


def test_memory_of_many_short_sets_is_bounded():
    rng = np.random.default_rng(8)
    n = 2 * ngram_join.BLOCK_SETS
    values = np.concatenate([np.tile([1, 2], (n, 1)), rng.integers(10, 10 ** 9, (n, 4))], axis=1)
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * n + 1, 6), pa.int32()), pa.array(values.ravel()))
    tracemalloc.start()
    a, _ = ngram_join.forest(arrays, np.full(n, 6), np.arange(n // 2), np.arange(n // 2, n), 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 0 and peak < 100 << 20


def test_removed_passages(documents, corpus):
    rows = substring_dedup.removed(documents).collect()
    texts = {i: t for i, t in corpus if i is not None}
    spans = {i: [] for i in texts}
    for r in rows:
        if r.doc_id is not None:
            spans[r.doc_id].append((r.begin, r.end))
            own = brute.words(texts[r.doc_id][r.begin:r.end])
            assert len(own) == r.n_words >= substring_dedup.LINE_WORDS
    wanted = brute.repeats([(i, t) for i, t in corpus if i is not None], 51)
    for i, windows in wanted.items():
        assert all(any(a < end and begin < b for begin, end in spans[i]) for a, b in windows)
    # Nothing goes that is not repeated: by a window of the least length, or within its own text.
    short = brute.repeats([(i, t) for i, t in corpus if i is not None], 27)
    for i, own in spans.items():
        assert not own or short[i] or i in (122, 125)
    assert not spans[72] and not spans[0] and spans[114] and spans[65]


def test_texts_without_their_repeats(documents, corpus):
    out = substring_dedup.without_repeats(documents)
    assert out.columns == documents.columns
    spans = substring_dedup.removed(documents).collect()
    kept = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    for i, text in corpus:
        if i is None:
            continue
        own = sorted((r.begin, r.end) for r in spans if r.doc_id == i)
        left = text
        for begin, end in reversed(own):
            left = left[:begin] + left[end:]
        if own and not brute.words(left):
            assert i not in kept
        else:
            assert kept[i].text == left and (not own or kept[i].n_chars == len(left))


def _whole_lines(text, least):
    """Words of each line and of each paragraph of more lines, with at least `least` words."""
    out, paragraph = [], []
    for line in (text or "").split("\n") + [""]:
        own = brute.words(line)
        if own:
            paragraph.append(own)
            out.append(tuple(own))
            continue
        if len(paragraph) > 1:
            out.append(tuple(w for x in paragraph for w in x))
        paragraph = []
    return [x for x in out if len(x) >= max(least, 1)]


@pytest.mark.parametrize("least", [1, 4])
def test_no_line_or_paragraph_of_the_least_length_stands_twice(spark, least):
    rng = random.Random(5)
    shared = [prose(rng, k).replace("\n", " ").strip() for k in (1, 2, 3, 4, 5, 9, 14, 30)]
    texts = []
    for _ in range(40):
        own = [prose(rng, 12).replace("\n", " ").strip() + f" {len(texts)}" for _ in range(5)]
        lines = own + rng.sample(shared, 4) + [""] * 2
        rng.shuffle(lines)
        texts.append("\n".join(x.upper() if rng.random() < 0.2 else "  " + x for x in lines))
    wrapped = "\n".join(shared[7].split(" "))  # the same words as a paragraph of short lines
    texts += ["before\n\n" + wrapped + "\n\nafter", None, "", "\n\n", wrapped, "x\r\n" + shared[5] + "\r\n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spans = {}
    for r in substring_dedup.removed(docs, line_words=least).collect():
        spans.setdefault(r.doc_id, []).append((r.begin, r.end))
    seen, wanted = set(), {}
    for i, text in rows:
        again = [x for k, x in enumerate(_whole_lines(text, least)) if x in seen or x in _whole_lines(
            text, least)[:k]]
        seen.update(_whole_lines(text, least))
        wanted[i] = Counter(w for x in set(again) for w in x)
    left = {}
    for i, text in rows:
        for begin, end in sorted(spans.get(i, []), reverse=True):
            text = text[:begin] + text[end:]
        left[i] = text
    stays = Counter(x for t in left.values() for x in _whole_lines(t, least))
    assert max(stays.values()) == 1
    for i, text in rows:  # nothing else goes, and what goes stands before
        gone = Counter(brute.words(text)) - Counter(brute.words(left[i]))
        assert set(gone) <= set(wanted[i]) or sum(gone.values()) >= substring_dedup.LEAST
        assert not wanted[i] or gone


def test_rows_without_id_are_held_against_each_other(spark):
    passage = prose(random.Random(9), 90)
    docs = spark.createDataFrame([(None, "one " + passage), (None, "two " + passage), (None, "two " + passage)],
                                 "doc_id long, text string")
    (span,) = substring_dedup.removed(docs).collect()
    assert span.doc_id is None and span.kept_doc_id is None and span.n_words > 60


def test_units_are_cut_by_their_own_words():
    rng = random.Random(11)
    passage = " ".join(prose(rng, 70).split()[:51])
    texts = [prose(rng, k) + passage + " " + prose(rng, 30) for k in (0, 13, 47)]
    found = substring_dedup.unit_arrays(pa.array(texts))
    digests = [set(found["digest"][found["text"] == i]) for i in range(3)]
    common = digests[0] & digests[1] & digests[2]
    size = found["n_words"][(found["text"] == 0) & np.isin(found["digest"], list(common))].sum()
    assert size >= substring_dedup.LEAST


ODD = ["", "<|endoftext|>a<|endoftext|>", " aaaa aaaaaaa  \n\n x'll 12 ½ 漢字 \U0001f600 é \xa0\xa0b",
       "a" * 5000, "\x1c\x85 \u3000x", "'s't're"]


@pytest.fixture(scope="module")
def merges():
    with open(vocabulary.default_path(), "rb") as file:
        return bpe.Merges(file.read())


def test_encoding_is_that_of_the_library(documents, corpus, merges, spark):
    library = Tokenizer.from_file(vocabulary.default_path())
    rng = random.Random(2)
    texts = [t or "" for _, t in corpus] + ODD + [
        "".join(rng.choice("abc ABC\n\t'sé漢\U0001f600½09.,<|> \u0300") for _ in range(60)) for _ in range(200)]
    ids, totals = bpe.Encoder(merges).encode(texts)
    ends = np.cumsum(totals)
    for text, a, b in zip(texts, ends - totals, ends):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == wanted
        assert merges.decode(ids[a:b]).decode() == library.decode(wanted, skip_special_tokens=False)


def test_long_pieces_are_merged_as_the_library_does(merges):
    library = Tokenizer.from_file(vocabulary.default_path())
    rng = random.Random(4)
    texts = ["a" * n for n in (63, 64, 65, 66, 5001)] + [
        "".join(rng.choice("ab") for _ in range(n)) for n in range(60, 90)] + [
        "".join(rng.choice(letters) for _ in range(n)) for letters, n in (
            ("acgt", 20_000), ("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("é漢ßx", 3_000))] + ["=" * 10_001]
    ids, totals = bpe.Encoder(merges).encode(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(totals)[:-1])):
        assert part.tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip(documents, corpus):
    library = Tokenizer.from_file(vocabulary.default_path())
    found = bpe.round_trip(documents, ["doc_id", "lang"])
    assert found.columns == ["doc_id", "lang", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = Counter()
    for i, text in corpus:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        wanted[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
               hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == wanted


def _word_pieces(starts, inner):
    entries = {x.decode("latin-1") for x in starts} | {"##" + x.decode("latin-1") for x in inner}
    ids = {x: i for i, x in enumerate(sorted(entries | {"[UNK]"}))}
    return models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10 ** 9)


@pytest.mark.parametrize("seed", range(30))
def test_counts_of_random_vocabularies(seed):
    rng = random.Random(seed)
    entry = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
    starts, inner = {entry() for _ in range(8)}, {entry() for _ in range(8)}
    model = _word_pieces(starts, inner)
    words = [bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 14)))
             for _ in range(300)]
    text = b" ".join(words).decode()
    n_words, n_tokens = token_counts.counts(token_counts.Matcher(starts, inner), pa.array([text, None, ""]))
    assert n_words.tolist() == [300, 0, 0]
    assert n_tokens.tolist() == [sum(len(model.tokenize(w.decode("latin-1"))) for w in words), 0, 0]


def test_token_counts(documents, corpus):
    with open(vocabulary.default_path(), "rb") as file:
        model = _word_pieces(*token_counts.word_pieces(file.read()))
    wanted = Counter()
    for i, text in corpus:
        own = (text or "").encode().split()
        wanted[i, len(own), sum(len(model.tokenize(w.decode("latin-1"))) for w in own)] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(documents).collect()) == wanted


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select(
        "toxic", "is_toxic", "severity").collect()
    caught = [r.is_toxic for r in rows if r.toxic]
    assert sum(caught) / len(caught) > 0.88
    assert sum(r.is_toxic for r in rows if not r.toxic) / sum(1 for r in rows if not r.toxic) < 0.01
    assert all(0 <= r.severity <= 2 for r in rows)


def test_grades_follow_their_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (900, 6)).astype(np.float32)
    strength = x @ np.array([2.0, 1.5, 1.0, 0, 0, 0]) + rng.logistic(0, 0.3, 900)
    grade = np.digitize(strength, [1.0, 2.5, 3.5])
    weights, cuts = toxicity.fit_grades(x, grade, penalty=0.0)
    assert (np.diff(cuts) > 0).all() and weights[0] > weights[1] > weights[2] > abs(weights[3:]).max()
    model = toxicity.Model(np.arange(6), weights, cuts)
    expected = model.above(x @ weights).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind(spark, documents, label):
    labels = spark.createDataFrame([(1, label), (2, label), (None, label), (3, None), (999, label)],
                                   "doc_id long, toxic int")
    rows = toxicity.score(documents, toxicity.fit(documents, labels)).collect()
    assert {r.is_toxic for r in rows} == {bool(label)} and len(rows) == documents.count()


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert quality_rules.judged(none, ["doc_id"]).count() == 0
    assert quality_rules.passing(none).count() == 0
    assert decontaminate.leaks(documents, items).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert ngram_join.linked_documents(none).count() == 0
    assert ngram_join.one_of_each(none).count() == 0
    assert substring_dedup.removed(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
    assert bpe.round_trip(none, ["doc_id"]).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_the_dearest_plans_have_no_cross_join(documents):
    plan = ngram_join.linked_documents(documents)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    native = quality_rules.measured(documents).select(F.count("n_words"))
    assert "Python" not in native._jdf.queryExecution().toString()
