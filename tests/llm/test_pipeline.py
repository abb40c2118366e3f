"""The pipeline against plain versions of its stages, stage by stage and as a whole."""

from __future__ import annotations

import brute
import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tallymill.llm import vocabulary
from tallymill.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    """Documents of which some fail, repeat, or hold a benchmark item."""
    path = tmp_path_factory.mktemp("corpus")
    item = " ".join(f"question{i}" for i in range(40))
    rows = [(300, f"These words stand before the passage {item} and these others follow after it.",
             "en", "host1", 0), (301, "This is a short text of twelve words that nobody else has here.",
                                 "en", "host2", 64)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.select(*COLUMNS).union(extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs = durable(stage(spark, docs, folder))
        if name == "bpe_encoding":
            break
        assert docs.columns == COLUMNS
        after = rows_of(docs)
        if name == "quality_rules":
            assert sorted(after, key=repr) == sorted(
                (x for x in before if not brute.measures(x[1])["base_failed"]), key=repr)
        elif name == "ngram_jaccard_join":
            sets = {i: brute.shingles(t, 5) for i, t in before if i is not None}
            classes = brute.components(sets, 80)
            assert sorted(after, key=repr) == sorted(
                (x for x in before if x[0] is None or classes[x[0]] == x[0]), key=repr)
        elif name == "substring_dedup":
            left, were = dict(after), dict(before)
            again = brute.repeats([x for x in after if x[0] is not None], 51)
            assert not any(again.values())
            clean = [i for i, spans in brute.repeats(
                [x for x in before if x[0] is not None], 27).items() if not spans]
            assert all(left[i] == were[i] for i in clean)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.doc_id and r.text != were[r.doc_id])
        else:
            leaked = {i for i, _ in brute.leaks(before, items)}
            assert leaked == {300}
            assert sorted(after, key=repr) == sorted((x for x in before if x[0] not in leaked), key=repr)
    library = Tokenizer.from_file(vocabulary.default_path())
    for r in docs.collect():
        ids = library.encode(dict(before)[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.drop("ids").collect(), key=repr) == sorted(docs.drop("ids").collect(), key=repr)


def test_an_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
