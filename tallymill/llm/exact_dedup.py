"""Exact duplicates by counting quotient filters, with bytes compared where fingerprints repeat.

Texts are equal when they are the same after all ASCII white space is taken out. A fingerprint is
the first 64 bits of the SHA-256 digest of what is left. Each partition puts its fingerprints
into counting quotient filters, one for each range of fingerprints; the filters of a range are
merged, and fingerprints with a count above one are read off the result. All other rows are
without an equal and are settled. Rows of repeated fingerprints go to byte verification: they are
grouped by their bytes, so fingerprints that collide come apart. Of equal texts the row with the
most code points stays, then that with the smallest id.

Filters hold a fingerprint once however often it occurs, and copies are summed within tasks before
they are shuffled, so a text that fills a third of the rows is no hot spot. The joins shuffle narrow
rows; Spark splits what is skewed there. Texts are read twice, and only those of repeated
fingerprints are shuffled, one copy a task (all are, if the repeated texts are too many to be broadcast).

Null text counts as empty, and empty and blank texts are equal to each other. A null id comes last. Rows
that tie in length and id are told apart by text, then one of the same rows stays: each group has
just one row that stays. Very long texts are taken whole. An empty table gives an empty result.
Other columns of the input, whatever their names, play no part and come out as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import quotient_filter
from tallymill.llm.common import if_small
from tallymill.session import cut_points, durable

# Fixed value: the bytes of white space; none of them is part of a longer UTF-8 character.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
# A merged filter holds about so many distinct fingerprints, a partition's filters at most so many rows.
RANGE = 1 << 18
FLUSH = 1 << 20
LEAST_PREFIX = 8
FILTER_SCHEMA = "prefix int, filter binary"
_KEY = ["fingerprint", "sha"]


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE_BYTES)


def _digest(body: bytes, bits: int) -> tuple[int, bytes]:
    """Fingerprint (its first `bits`, the others zero) as a signed number, and SHA-256 digest."""
    sha = hashlib.sha256(body).digest()
    held = int.from_bytes(sha[:8], "big") >> (64 - bits) << (64 - bits)
    return held - (held >> 63 << 64), sha


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(key, n_chars, raw, row, fingerprint, sha) of every row. `raw` is a hash of the text as it is."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.length(body).cast("long").alias("n_chars"),
                       F.xxhash64(body).alias("raw"), F.monotonically_increasing_id().alias("row"),
                       body.cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(normalised(x.as_py()), bits) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "n_chars", "raw", "row")),
                 pa.array([f for f, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())],
                ["key", "n_chars", "raw", "row", *_KEY])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_chars long, raw long, row long, fingerprint long, sha binary")


def filters(rows: DataFrame, prefix_bits: int) -> DataFrame:
    """(prefix, filter): the counting quotient filters of each partition's column `fingerprint`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= FLUSH:
                yield _filter_rows(np.concatenate(held), prefix_bits)
                held, size = [], 0
        if size:
            yield _filter_rows(np.concatenate(held), prefix_bits)

    return rows.select("fingerprint").mapInArrow(run, FILTER_SCHEMA)


def _filter_rows(values: np.ndarray, prefix_bits: int) -> pa.RecordBatch:
    made = quotient_filter.by_range(values, prefix_bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(made), pa.int32()), pa.array(map(quotient_filter.packed, made.values()), pa.binary())],
        ["prefix", "filter"])


def merged(parts: DataFrame, prefix_bits: int) -> DataFrame:
    """(prefix, filter): one filter for each range of fingerprints."""

    def run(group: pa.Table) -> pa.Table:
        whole = quotient_filter.merge(
            (quotient_filter.unpacked(x.as_py()) for x in group.column("filter")), prefix_bits)
        return pa.table({"prefix": group.column("prefix").slice(0, 1),
                         "filter": pa.array([quotient_filter.packed(whole)], pa.binary())})

    return parts.groupBy("prefix").applyInArrow(run, FILTER_SCHEMA)


def repeated(whole: DataFrame) -> DataFrame:
    """(fingerprint, copies) of what merged filters count more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("filter"):
                found, counts = quotient_filter.contents(quotient_filter.unpacked(x.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[counts > 1].view(np.int64)), pa.array(counts[counts > 1])],
                    ["fingerprint", "copies"])

    return whole.mapInArrow(run, "fingerprint long, copies long")


def _verified(docs: DataFrame, text: str, suspects: DataFrame, bits: int) -> DataFrame:
    """(fingerprint, sha, group_size): rows whose text hash is among `suspects`, grouped by their bytes."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("raw"), body.cast("binary").alias("body")).join(
        if_small(suspects), "raw", "left_semi").select("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [normalised(x.as_py()) for x in batch.column("body")]
            found = [_digest(x, bits) for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()),
                 pa.array(bodies, pa.binary())], [*_KEY, "body"])

    return rows.mapInArrow(run, "fingerprint long, sha binary, body binary").groupBy(*_KEY, "body").agg(
        F.count(F.lit(1)).alias("group_size")).drop("body")


def prefix_bits_for(rows: int) -> int:
    return max(LEAST_PREFIX, math.ceil(math.log2(max(rows, 1) / RANGE)))


def _judged(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(key, n_chars, raw, keep_key, group_size, kept, sha), written; all else that was written goes."""
    with cut_points(docs.sparkSession) as cut:
        rows = cut(fingerprints(docs, key, text, bits))
        prefix_bits = prefix_bits_for(rows.count())
        often = cut(repeated(merged(cut(filters(rows, prefix_bits)), prefix_bits)))
        suspect = cut(rows.join(often.select("fingerprint"), "fingerprint", "left_semi"))
        groups = cut(_verified(docs, text, cut(suspect.select("raw").distinct()), bits))
        if not groups.groupBy(*_KEY).count().where("count > 1").isEmpty():
            raise ValueError("different texts share a SHA-256 digest")
        best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("key").isNull().alias("none"),
                              "key", "raw", "row")).alias("best")
        chosen = suspect.groupBy(*_KEY).agg(best).select(
            *_KEY, F.col("best.key").alias("keep_key"), F.col("best.row").alias("keep_row"))
        classes = cut(groups.where("group_size > 1").join(chosen, _KEY))
        joined = rows.join(classes, _KEY, "left")
        alone = F.col("group_size").isNull()
        return durable(joined.select(
            "key", "n_chars", "raw", F.when(alone, F.col("key")).otherwise(F.col("keep_key")).alias("keep_key"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "sha"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """A row for each of `docs`: its id, `keep_id`, `group_size`, `kept` and `text_sha256`.

    `bits` is the length of a fingerprint; the result does not depend on it.
    """
    return _judged(docs, key, text, bits).select(
        F.col("key").alias(key), F.col("keep_key").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they are. Of rows with the same id and text that
    stays which Spark meets first."""
    judged = _judged(docs, key, text, 64).groupBy("key", "raw").agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT stays")
    spark, marks = docs.sparkSession, ["__key", "__raw"]
    with cut_points(spark) as cut:
        odd = cut(judged.select(F.col("key").alias("__key"), F.col("raw").alias("__raw"),
                                F.col("stays").alias("__stays")))
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        met = docs.withColumns({"__doc": F.col(key), "__text": F.xxhash64(body)}).join(
            if_small(odd), F.col("__doc").eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__raw")), "left")
        plain = met.where(F.col("__stays").isNull())
        once = met.where(F.col("__stays")).dropDuplicates(marks)
        return durable(plain.unionByName(once).select(*docs.columns))
