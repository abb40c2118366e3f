"""Passages that repeat, found by hashing units of text, with the spans they have in the original.

Units are normalised to their words (A-Z lower-cased, white space ignored). There are three kinds,
whose digests are grouped together over all documents:

* lines, and paragraphs of more than one line (a line without words ends a paragraph), of at least
  `line_words` words. No such line or paragraph of a later document is left whole.
* cut units, for passages that begin and end within lines: text is cut where the digest of two
  neighbouring words is the least of WINDOW neighbouring digests. Cuts follow from the words around
  them alone, so a passage is cut alike wherever it stands, except for its first and last WINDOW
  words. Runs of repeated cut units with at least `least` words in a row are removed: every passage
  of 2 * WINDOW + `least` words or more is found; up to WINDOW words at each of its ends stay.

The earliest occurrence is kept: lowest doc_id, then place in the text. Spans that touch are one.

Null and blank texts have no units. Rows that repeat a row count as one document. Rows that share an
id but not the text are not held against each other. Rows without id rank last, among
themselves by the digest of their text. Very long texts are cut as they are. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.common import FlatWords, if_small, mix, slices
from tallymill.session import cut_points, durable

WINDOW = 12
# So that every passage of 51 words or more is found.
LEAST = 27
# Least length of a line or paragraph. Shorter lines are often alike by chance in documents that have
# nothing else in common; with 1 every line that has words counts.
LINE_WORDS = 20
CUT, LINE, PARAGRAPH = range(3)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
# `word`: place of the first word. `begin` and `end` count characters. `again`: an equal unit stands
# earlier in this text.
UNIT_SCHEMA = ("doc_key long, doc_rank long, kind byte, unit int, digest long, word int, n_words int, "
               "begin int, end int, again boolean")


def cuts(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words begin a unit; `first` has the first word of each text and, last, the end."""
    starts = np.zeros(len(hashes), bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    if len(hashes) > window:
        pairs = mix(hashes[:-1] * _FACTOR + hashes[1:])  # pairs[i] stands between words i and i + 1
        views = np.lib.stride_tricks.sliding_window_view(pairs, window)
        at = np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = text[:len(views)] == text[window:]  # all words of the window are of one text
        starts[at[inside] + 1] = True
    return starts


def lines_and_paragraphs(words: FlatWords) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin a line, and which a paragraph."""
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    step, text = np.diff(line, prepend=-2), np.diff(words.text_of_word(), prepend=-1) > 0
    return text | (step > 0), text | (step > 1)


def unit_arrays(texts: pa.Array, window: int = WINDOW,
                line_words: int = LINE_WORDS) -> dict[str, np.ndarray]:
    """The units of some texts by kind and place: the columns of UNIT_SCHEMA and `text`."""
    words = FlatWords(texts)
    hashes, text_of = words.hashes(), words.text_of_word()
    lines, paragraphs = lines_and_paragraphs(words)
    line_of = np.cumsum(lines)
    parts = []
    for kind, starts in ((CUT, cuts(hashes, words.first, window)), (LINE, lines), (PARAGRAPH, paragraphs)):
        head = np.flatnonzero(starts)
        size = np.diff(np.append(head, len(hashes)))
        # A digest is the sum of its words' hashes times powers of a constant by place.
        place = np.arange(len(hashes)) - np.repeat(head, size)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(
            int(size.max()) if len(size) else 0, _FACTOR))])
        sums = np.add.reduceat(hashes * powers[place], head) if len(head) else hashes
        digest = mix(sums + size.astype(np.uint64)).view(np.int64)
        if kind != CUT:
            held = size >= line_words
            if kind == PARAGRAPH:  # one of a single line is that line
                held &= line_of[head + size - 1] > line_of[head]
            head, size, digest = head[held], size[held], digest[held]
        parts.append((np.full(len(head), kind), head, size, digest))
    kind, head, size, digest = (np.concatenate(x) for x in zip(*parts))
    text = text_of[head]
    order = np.lexsort((head, digest, kind == CUT, text))
    again = np.zeros(len(head), bool)
    same = [x[order[1:]] == x[order[:-1]] for x in (text, kind == CUT, digest)]
    again[order[1:]] = same[0] & same[1] & same[2]
    first = np.ones(len(head), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(head))
    before = words.characters(words.bounds[:-1])[text]
    return {"text": text, "kind": kind, "unit": at - np.maximum.accumulate(np.where(first, at, 0)),
            "digest": digest, "word": head - words.first[text], "n_words": size,
            "begin": words.characters(words.start[head]) - before,
            "end": words.characters(words.end[head + size - 1]) - before, "again": again}


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a key of id and text, and the id as rank."""
    return docs.withColumns({
        "doc_key": F.xxhash64("doc_id", "text"),
        "doc_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1))})


def units(docs: DataFrame, window: int = WINDOW, line_words: int = LINE_WORDS) -> DataFrame:
    """The units of every document."""
    types = {"kind": pa.int8(), "digest": pa.int64(), "again": pa.bool_()}
    names = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = unit_arrays(part.column("text"), window, line_words)
                text = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_key").take(text), part.column("doc_rank").take(text),
                    *(pa.array(found[c], types.get(c, pa.int32())) for c in names[2:])], names)

    return keyed(docs.select("doc_id", "text")).select("doc_key", "doc_rank", "text").mapInArrow(
        run, UNIT_SCHEMA)


def repeated_spans(docs: DataFrame, window: int = WINDOW, least: int = LEAST,
                   line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_key, doc_rank, begin, end, n_words, kept_rank): what to remove from each document.

    The spans are written; the units go.
    """
    # Rows without id share a rank; the key, a digest of their text, decides among them.
    key = F.when(F.col("doc_rank") == 2 ** 63 - 1, F.col("doc_key"))
    with cut_points(docs.sparkSession) as cut:
        pieces = cut(units(docs, window, line_words))
        firsts = cut(pieces.groupBy("digest").agg(
            F.min("doc_rank").alias("kept_rank"), F.min(key).alias("kept_key"),
            F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        # Repeated digests grow with the corpus: both sides are shuffled, and a hot one is split.
        later = pieces.join(firsts, "digest").where(
            F.col("again") | (F.col("kept_rank") < F.col("doc_rank"))
            | ((F.col("kept_rank") == F.col("doc_rank")) & (F.col("kept_key") < key)))
        rows = later.drop("digest", "again", "kept_key").repartition("doc_key").dropDuplicates(
            ["doc_key", "kind", "unit"])
        place = F.row_number().over(Window.partitionBy("doc_key", "kind").orderBy("unit"))
        # Cut units that follow each other are a run; a line or paragraph stands for itself.
        run = F.col("unit") - F.when(F.col("kind") == CUT, place).otherwise(0)
        spans = rows.withColumn("run", run).groupBy("doc_key", "kind", "run").agg(
            *(F.min(c).alias(c) for c in ("doc_rank", "word", "begin", "kept_rank")),
            F.max("end").alias("end"), F.max(F.col("word") + F.col("n_words")).alias("stop")).where(
            (F.col("kind") != CUT) | (F.col("stop") - F.col("word") >= least))
        by_word = Window.partitionBy("doc_key").orderBy("word", "stop")
        reached = F.max("stop").over(by_word.rowsBetween(Window.unboundedPreceding, -1))
        apart = spans.withColumn("apart", F.when(F.col("word") <= reached, 0).otherwise(1))
        return durable(apart.withColumn("span", F.sum("apart").over(by_word.rowsBetween(
            Window.unboundedPreceding, 0))).groupBy("doc_key", "span").agg(
            F.min("doc_rank").alias("doc_rank"), F.min("begin").alias("begin"), F.max("end").alias("end"),
            (F.max("stop") - F.min("word")).alias("n_words"), F.min("kept_rank").alias("kept_rank")).drop("span"))


def removed(docs: DataFrame, window: int = WINDOW, least: int = LEAST,
            line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, begin, end, n_words, kept_doc_id): the spans of each id, in characters."""
    none = lambda c: F.when(F.col(c) < 2 ** 63 - 1, F.col(c))
    return repeated_spans(docs, window, least, line_words).select(
        none("doc_rank").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"),
        "n_words", none("kept_rank").cast(docs.schema["doc_id"].dataType).alias("kept_doc_id"))


def without_repeats(docs: DataFrame, window: int = WINDOW, least: int = LEAST,
                    line_words: int = LINE_WORDS, length: str | None = "n_chars") -> DataFrame:
    """`docs` with repeated passages taken out of the text and the column `length` brought into line.

    Texts without a repeat stay as they are; documents of which only white space is left go.
    """
    spans = durable(repeated_spans(docs, window, least, line_words).groupBy("doc_key").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__spans")).withColumnRenamed(
        "doc_key", "__key"))
    hit = docs.withColumn("__doc", F.xxhash64("doc_id", "text")).join(
        if_small(spans, weight=F.size("__spans")), F.col("__doc") == F.col("__key"), "left")
    # Kept pieces: from the end of each span (or the start) to the begin of the next (or the end).
    count = F.size("__spans")
    begins = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    ends = F.concat(F.transform("__spans", lambda s: s["begin"]), F.array(F.length("text")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    text = F.when(count > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    out = hit.withColumn("__text", text).where(
        (F.coalesce(count, F.lit(0)) <= 0) | F.col("__text").rlike("[^\\x20\\x09-\\x0D]"))
    shown = {"text": F.col("__text")}
    if length in docs.columns:
        shown[length] = F.when(count > 0, F.length("__text").cast(docs.schema[length].dataType)
                               ).otherwise(F.col(length))
    return out.select(*[shown.get(c, F.col(c)).alias(c) for c in docs.columns])
