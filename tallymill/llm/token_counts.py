"""Word-piece counts by one walk over each word, without building pieces.

Greedy word-piece cutting takes the longest vocabulary entry at the start of a word, then the
longest continuation entry, and so on. The vocabulary's trie gets, for every node, a failure link
(where the walk stands after the longest entries below the node are taken off its front) and the
number of entries taken. A letter either extends the match or adds the precomputed number
and follows the link, so a word costs time in its length. All distinct words of a batch walk
together, one byte per numpy step.

A word that cannot be cut counts as one unknown token. Null and empty texts have no words and no
tokens. Repeated rows are counted alike; other columns are dropped. An empty table gives an empty
result. There is no limit on the length of a word or text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymill.llm import vocabulary
from tallymill.llm.common import FlatWords, slices

NOWHERE = -1


def word_pieces(content: bytes) -> tuple[set[bytes], set[bytes]]:
    """Start and continuation entries of a byte-level vocabulary: tokens with the letter for a
    space in front start words, the others continue them, and any token may start a text's word."""
    space = {c for c, b in vocabulary.byte_of_letter().items() if b == 32}.pop()
    tokens = vocabulary.parsed(content)["model"]["vocab"]
    inner = {vocabulary.as_bytes(t) for t in tokens if space not in t}
    return inner | {vocabulary.as_bytes(t[1:]) for t in tokens
                    if t[0] == space and len(t) > 1 and space not in t[1:]}, inner


class Matcher:
    """Trie of both kinds of entries under two roots (0: word start, 1: continuation)."""

    def __init__(self, starts: set[bytes], inner: set[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, entries in ((0, starts), (1, inner)):
            for entry in sorted(entries):
                node = root
                for byte in entry:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                        ends.append(False)
                    node = children[node][byte]
                ends[node] |= node > 1
        self._link(children, ends)
        keys = np.array([n * 256 + b for n, own in enumerate(children) for b in own], np.int64)
        to = np.array([c for own in children for c in own.values()], np.int64)
        order = np.argsort(keys)
        # A last key that no search can find, so that a search always lands on a key.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.to = np.append(to[order], NOWHERE)

    def _link(self, children: list[dict[int, int]], ends: list[bool]) -> None:
        link, taken = [NOWHERE] * len(children), [0] * len(children)
        level = [0, 1]
        while level:
            following = []
            for node in level:
                for byte, child in children[node].items():
                    following.append(child)
                    if ends[child]:
                        link[child], taken[child] = 1, 1
                        continue
                    at, count = link[node], taken[node]
                    while at != NOWHERE and byte not in children[at]:
                        at, count = link[at], count + taken[at]
                    if at != NOWHERE:
                        link[child], taken[child] = children[at][byte], count
            level = following
        self.link, self.taken = np.array(link, np.int64), np.array(taken, np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys = node * 256 + byte
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.to[at], NOWHERE)

    def lengths(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of pieces of each word data[start:start + size]; 1 for a word without a cut."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        node, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        for place in range(int(size[0]) if len(size) else 0):
            live = live[:np.searchsorted(-size[live], -place, side="left")]
            if not len(live):
                break
            byte = data[start[live] + place].astype(np.int64)
            self._advance(node, count, live, byte)
            live = live[node[live] != NOWHERE]
        # The rest of each word is taken off until nothing but the continuation root is left.
        open_ = np.flatnonzero((node != NOWHERE) & (node != 1))
        while len(open_):
            count[open_] += self.taken[node[open_]]
            node[open_] = self.link[node[open_]]
            open_ = open_[(node[open_] != NOWHERE) & (node[open_] != 1)]
        count[node == NOWHERE] = 1
        out = np.empty(len(count), np.int64)
        out[order] = count
        return out

    def _advance(self, node: np.ndarray, count: np.ndarray, live: np.ndarray, byte: np.ndarray) -> None:
        while len(live):
            to = self._step(node[live], byte)
            stuck = to == NOWHERE
            node[live[~stuck]] = to[~stuck]
            live, byte = live[stuck], byte[stuck]
            count[live] += self.taken[node[live]]
            node[live] = self.link[node[live]]
            going = node[live] != NOWHERE
            live, byte = live[going], byte[going]


@lru_cache(maxsize=1)
def _matcher(content: bytes) -> Matcher:
    return Matcher(*word_pieces(content))


def counts(matcher: Matcher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text; words with one digest are walked once."""
    words = FlatWords(texts)
    if not len(words.start):
        return words.counts, np.zeros(len(words.counts), np.int64)
    _, first, which = np.unique(words.hashes(fold=False), return_index=True, return_inverse=True)
    lengths = matcher.lengths(words.data, words.start[first], (words.end - words.start)[first])
    sums = np.concatenate([[0], np.cumsum(lengths[which])])
    return words.counts, sums[words.first[1:]] - sums[words.first[:-1]]


def token_counts(docs: DataFrame, key: str = "doc_id", path: str | None = None,
                 text: str = "text") -> DataFrame:
    """`key`, `n_words` and `n_tokens` of every row."""
    file = vocabulary.shared_file(docs.sparkSession, path)
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(file.value)
        for batch in batches:
            for part in slices(batch, text):
                n_words, n_tokens = counts(matcher, part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(n_words), pa.array(n_tokens)],
                    [key, "n_words", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, schema)
