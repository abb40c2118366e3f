"""What several operators share: tables, sized broadcasts, words of text in flat numpy arrays."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"
# A table is broadcast only if it was written, counted and found to have at most so many rows.
BROADCAST_ROWS = 1_000_000
SLICE_BYTES = 1 << 20
LONG_WORD = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def if_small(df: DataFrame, rows: int | None = None, weight: Column | None = None) -> DataFrame:
    """`df`, a written table of a few narrow columns, marked for broadcast if it has few rows.

    Where rows hold arrays, `weight` tells how many narrow rows each of them counts for. Beyond the bound
    (BROADCAST_ROWS) Spark joins by shuffle and splits skewed partitions.
    """
    size = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_ROWS if rows is None else rows) else df


_GIVEN: set[str] = set()


def give_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application.

    Functions that run in tasks import it there. Only the driver reads the archive's file; Spark
    sends it on.
    """
    context = spark.sparkContext
    if context.applicationId in _GIVEN:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _GIVEN.add(context.applicationId)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of words; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


# --- Flat words: all words of many texts as arrays, so that a step is one numpy call ---

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
# Other than letters, digits and bytes of non-ASCII characters.
_PUNCTUATION = np.array([not (chr(b).isalnum() or b > 127) if b < 128 else False
                         for b in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(LONG_WORD, _ODD, np.uint64))])


class FlatWords:
    """Words of a run of texts: `start`, `end` in `data`, `first[i]:first[i+1]` are text i's."""

    def __init__(self, texts: pa.Array, punctuation: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.data = whole[bounds[0]:bounds[-1]]
        self.bounds = bounds - bounds[0]
        inside = ~(_PUNCTUATION if punctuation else _SPACES)[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(inside))]
        begins[inner] |= inside[inner]
        ends[inner - 1] |= inside[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: bool = True, limit: int | None = None) -> np.ndarray:
        """64 bits for each word, or its first `limit` bytes; with `fold`, A-Z are taken as a-z."""
        out = np.zeros(len(self.start), np.uint64)
        size = self.end - self.start
        if limit is not None:
            size = np.minimum(size, limit)
        runs = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + SLICE_BYTES, SLICE_BYTES))
        for a, b in zip(runs, np.append(runs[1:], len(size))):
            if a < b:
                out[a:b] = self._run_hashes(self.start[a:b], size[a:b], fold)
        return mix(out + size.astype(np.uint64))

    def _run_hashes(self, start: np.ndarray, size: np.ndarray, fold: bool) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        short = size <= LONG_WORD
        for i in np.flatnonzero(~short):
            word = self.data[start[i]:start[i] + size[i]].tobytes()
            word = word.lower() if fold else word
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        start, size = start[short], size[short]
        if len(size):
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            letters = (_FOLDED if fold else _LETTERS)[self.data[place + np.repeat(start, size)]]
            out[short] = np.add.reduceat(letters * _POWERS[place], begin)
        return out

    def characters(self, positions: np.ndarray) -> np.ndarray:
        """Code points before each byte position."""
        if not hasattr(self, "_seen"):
            self._seen = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return self._seen[positions]


def slices(batch: pa.RecordBatch, column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each; a longer text is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(lengths)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield batch.slice(int(a), int(b - a))
