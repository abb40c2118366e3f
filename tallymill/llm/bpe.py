"""Byte-pair encoding and decoding of whole texts in numpy merge rounds.

Texts are cut into added tokens and pieces (the pattern of byte-level vocabularies). Pieces not
seen before by a worker are encoded together: their symbols lie in one flat array, and in each
round every piece merges its lowest-ranked pair, found by binary search over sorted pair keys.
Rounds over long pieces touch only the places they merge and their neighbours, so that a word of
a million letters takes seconds.
Documents are then put together from piece ids, and ids are turned back into bytes by gathers.

Ids are kept packed (little-endian unsigned 32 bits), so that counting, hashing and storing
them needs no Python. Null text is encoded as empty text: no ids, decoded to empty text.
Repeated rows are encoded alike; other columns are carried along unless they are named `ids` or
`n_tokens`, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.llm import vocabulary
from tallymill.llm.common import slices

# Fixed value: how byte-level vocabularies cut text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pieces that a worker remembers; beyond it the memory is emptied and filled again.
REMEMBERED = 150_000
# Pieces of more bytes are merged by rank; the number of rounds over the others is below this.
LONG_PIECE = 64


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i]:start[i] + size[i]] for all i, one after the other."""
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return values[np.arange(len(shift)) + shift]


def _every_second(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places that follow each other (a pair like `aa` in `aaa`) every second one holds."""
    at = np.arange(len(places))
    head = np.ones(len(places), bool)
    head[1:] = after[:-1] != places[1:]
    return (at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0


class Merges:
    """The merge table: sorted keys of (left, right), with their rank and the merged id."""

    def __init__(self, content: bytes):
        file = vocabulary.parsed(content)
        ids, merges = file["model"]["vocab"], file["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = np.int64(max([*ids.values(), *self.added.values()]) + 1)
        keys = np.array([ids[a] for a, _ in pairs], np.int64) * self.width + np.array(
            [ids[b] for _, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        letters = {b: c for c, b in vocabulary.byte_of_letter().items()}
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int64)
        texts = [b""] * int(self.width)
        for token, i in ids.items():
            texts[i] = vocabulary.as_bytes(token)
        for token, i in self.added.items():
            texts[i] = token.encode()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        long = np.repeat(sizes > LONG_PIECE, sizes)
        done = [self._rounds(symbols[~long], piece[~long]), self._by_rank(symbols[long], piece[long])]
        symbols, piece = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))

    def _rounds(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their pieces after all merges: each round passes over all pieces not done."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], piece[:0])]
        none = len(self.keys)
        while len(symbols):
            ranks = np.full(len(symbols), none)
            ranks[:-1] = np.where(piece[:-1] == piece[1:], self.rank(symbols[:-1], symbols[1:]), none)
            heads = np.flatnonzero(np.diff(piece, prepend=-1))
            lengths = np.diff(np.append(heads, len(piece)))
            lowest = np.repeat(np.minimum.reduceat(ranks, heads), lengths)
            over = lowest == none
            if over.any():
                done.append((symbols[over], piece[over]))
                symbols, piece, ranks, lowest = (x[~over] for x in (symbols, piece, ranks, lowest))
                if not len(symbols):
                    break
            hit = ranks == lowest
            hit[hit] = _every_second(np.flatnonzero(hit), np.flatnonzero(hit) + 1)
            symbols = np.where(hit, self.merged[np.where(hit, ranks, 0)], symbols)
            keep = np.ones(len(hit), bool)
            keep[1:] = ~hit[:-1]
            symbols, piece = symbols[keep], piece[keep]
        symbols, piece = (np.concatenate(x) for x in zip(*done))
        return symbols, piece

    def _by_rank(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long pieces: places wait under the rank of their pair, a round takes the
        lowest rank of all and touches the places under it and their neighbours only."""
        n, none = len(symbols), len(self.keys)
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(n, none)  # of the pair that begins at a place
        if n:
            ranks[:-1] = np.where(piece[:-1] == piece[1:], self.rank(symbols[:-1], symbols[1:]), none)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] < none]
            places = places[np.argsort(ranks[places], kind="stable")]
            under = ranks[places]
            heads = np.flatnonzero(np.diff(under, prepend=-1))
            for rank, a, b in zip(under[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(under)]):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(places[a:b])

        wait(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            found = waiting.pop(rank)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[ranks[places] == rank]  # others changed since they began to wait
            places = places[_every_second(places, after[places])]
            gone = after[places]
            symbols[places] = self.merged[rank]
            alive[gone], ranks[gone] = False, none
            after[places] = after[gone]
            within = after[places] < n
            before[after[places][within]] = places[within]
            left = before[places]
            changed = np.concatenate([places, left[left >= 0]])
            right = after[changed]
            changed, right = changed[right < n], right[right < n]
            ranks[places] = none
            ranks[changed] = np.where(piece[changed] == piece[right],
                                      self.rank(symbols[changed], symbols[right]), none)
            wait(np.unique(changed))
        return symbols[alive], piece[alive]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; sequences that are no UTF-8 become U+FFFD."""
        found = gather(self.bytes, self.start[ids], self.size[ids]).tobytes()
        return found.decode("utf-8", "replace").encode()


class Encoder:
    """Remembers the ids of pieces, so that a piece is merged once."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.cut = regex.compile(PIECES)
        self.added = regex.compile("|".join(
            regex.escape(t) for t in sorted(merges.added, key=len, reverse=True))) if merges.added else None
        self._forget()

    def _forget(self) -> None:
        self.known = {token: i for i, token in enumerate(self.merges.added)}
        self.ids = np.array([*self.merges.added.values()], np.uint32)
        self.size = np.ones(len(self.known), np.int64)
        self.start = np.arange(len(self.known))

    def _pieces(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.cut.findall(text)
        out, at = [], 0
        for hit in self.added.finditer(text):
            out += self.cut.findall(text[at:hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + self.cut.findall(text[at:])

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = self.merges.encode([p.encode() for p in pieces])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED * 8:
            self._forget()
        parts = [self._pieces(t) if t else [] for t in texts]
        new = {p for part in parts for p in part if p not in self.known}
        if new:
            self._learn(sorted(new))
        find = self.known.__getitem__
        index = np.fromiter((find(p) for part in parts for p in part), np.int64,
                            sum(map(len, parts)))
        sizes = self.size[index]
        whose = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        totals = np.bincount(whose, sizes, len(parts)).astype(np.int64)
        return gather(self.ids, self.start[index], sizes), totals


@lru_cache(maxsize=1)
def _encoder(content: bytes) -> Encoder:
    return Encoder(Merges(content))


def _binary(data: np.ndarray, totals: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(totals * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(totals), [
        None, pa.py_buffer(offsets), pa.py_buffer(data.astype("<u4"))])


def _without(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """`docs` without its text, with packed `ids` and `n_tokens`."""
    file = vocabulary.shared_file(docs.sparkSession, path)
    carried = _without(docs, text, "ids", "n_tokens")
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for batch in batches:
            for part in slices(batch, text):
                ids = _binary(*encoder.encode(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), ids], [*carried, "ids"])

    return docs.select(*carried, text).mapInArrow(run, schema).withColumn(
        "n_tokens", (F.length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """`encoded` with the text that its packed `ids` stand for; null ids give empty text."""
    file = vocabulary.shared_file(encoded.sparkSession, path)
    carried = _without(encoded, text)
    schema = T.StructType([*(encoded.schema[c] for c in carried), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(file.value).merges
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [merges.decode(np.frombuffer(x or b"", "<u4")) for x in
                         part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(texts, pa.binary()).cast(pa.string())],
                    [*carried, text])

    return encoded.select(*carried).mapInArrow(run, schema)


def round_trip(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """`columns` and packed `ids`, `n_tokens`, and digests of the ids and of the decoded text."""
    wanted = [c for c in columns if c not in ("ids", "n_tokens", "text")]
    encoded = encode(docs.select(*wanted, "text"), path)
    return decode(encoded, path, "__decoded").select(
        *wanted, "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("__decoded", 256).alias("decoded_sha256"))
