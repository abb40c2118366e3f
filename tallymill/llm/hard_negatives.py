"""Hard negatives by a vertical scan of embeddings that narrows its candidates dimension by dimension.

Components become whole numbers, floor(scale * c), held at the ends of a long; a score is an inner
product of such vectors, exact. Rows lie in blocks, each dimension of a block in one piece. An anchor
reads the dimensions of a block in the order of its own magnitudes, the largest first, a few at a
time. What the remaining dimensions can still add to a score lies between bounds that follow
from the anchor and the least and greatest value of each dimension in the block. Candidates whose
bounds show that they cannot be wanted leave the bitmap; those left after the last dimension have
exact scores. The first scan looks for each anchor's best rows of its own label (positives), the
second for the best rows of other labels within a window of scores below each positive; a row leaves
it once it is outside of all windows, or below what is already sure to fill them.

Anchors are a stated set of rows, met with all rows in blocks: rows are dealt into stripes and anchors
into groups, and each pair of a stripe and a group is one task's work, of bounded size and the same for
all. A task keeps a few rows for each anchor; the best over all stripes are picked by a window of a
few rows for each stripe. There is no key that grows with the data, and no label or vector is one.

Rows with a null label, a null vector or a component that is null or not finite take no part. Rows
with a null id take part as positives and negatives, last among equal scores, and are no anchors. Each
row counts for itself: rows that repeat an id or a whole row are rows of their own, an anchor is only
not its own positive, and anchors that share an id are mined apart. Vectors are held against
vectors of their own length only. Without a second row of its label an anchor has no positives, and a
positive without a row in its window has no negatives. A score beyond a long is an error, not a wrong
number. An empty table gives an empty result. Other columns of the input, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import cut_points, durable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# A negative's score is between these shares of the positive's, in hundredths.
LEAST_PERCENT, MOST_PERCENT = 50, 95
STEP = 8
BLOCK_ROWS = 4096
# A stripe or group is a share of the data, within bounds: small data is still dealt to many tasks.
STRIPES, STRIPE_BLOCKS = 16, 64
GROUPS, GROUP_ANCHORS = 4, 4096
_NONE = 2 ** 63 - 1
_EXACT = 2 ** 53
_BLOCK = "width int, block long, n int, ids binary, labels binary, keys binary, cells binary, size int"
_FOUND = "anchor_key long, anchor_id long, goal int, key long, id long, score long"


class Block(NamedTuple):
    """Rows side by side: `cells[d]` is dimension d of all of them."""

    ids: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    cells: np.ndarray


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                  scale: int = SCALE) -> DataFrame:
    """(id, label, x: array of long) of the rows that take part."""
    cells = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       cells.alias("cells")).where(F.col("label").isNotNull() & F.col("cells").isNotNull()).where(good)
    return kept.select("id", "label", F.transform("cells", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (key, id, label, x) as blocks; null ids become the largest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            widths = batch.column("x").value_lengths().to_numpy()
            for width in sorted(set(widths.tolist())):
                held.setdefault(width, []).append(batch.filter(pa.array(widths == width)))
                if sum(b.num_rows for b in held[width]) >= block_rows:
                    yield from _packed(width, held.pop(width), block_rows)
        for width, parts in held.items():
            yield from _packed(width, parts, block_rows)

    return rows.select("key", "id", "label", "x").mapInArrow(run, _BLOCK)


def _packed(width: int, parts: list[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    for at in range(0, len(whole), block_rows):
        part = whole.slice(at, block_rows)
        keys, labels = (part.column(c).to_numpy() for c in ("key", "label"))
        ids = part.column("id").fill_null(_NONE).to_numpy()
        cells = part.column("x").combine_chunks().flatten().to_numpy().reshape(len(part), width).T
        # In the narrowest whole numbers that hold them.
        top = max(abs(int(cells.min(initial=0))), int(cells.max(initial=0)))
        kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max or k is np.int64)
        packed = [np.ascontiguousarray(a).tobytes() for a in (ids, labels, keys, cells.astype(kind))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([keys[0]], pa.int64()), pa.array([len(part)], pa.int32()),
             *(pa.array([p], pa.binary()) for p in packed), pa.array([kind().itemsize], pa.int32())],
            ["width", "block", "n", "ids", "labels", "keys", "cells", "size"])


def _unpacked(row: dict) -> Block:
    ids, labels, keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "keys"))
    cells = np.frombuffer(row["cells"], f"<i{row['size']}").reshape(row["width"], row["n"])
    return Block(ids, labels, keys, cells)


# --- The scan of one block for one anchor ---

Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def scan(anchor: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray,
         candidates: np.ndarray, keep: Keep, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that `keep` leaves, as places, with their exact scores.

    `least` and `most` bound each dimension of `cells`; `candidates` is a bitmap. After every
    `step` dimensions `keep(places, low, high)` says which rows stay, given bounds of their scores.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor[order] * least[order], anchor[order] * most[order]
    rest = [np.concatenate([np.cumsum(f(one, other)[::-1])[::-1], [0]]) for f in (np.minimum, np.maximum)]
    places = np.flatnonzero(candidates)
    partial = np.zeros(len(places), cells.dtype)
    for at in range(0, len(order), step):
        if not len(places):
            break
        read = order[at:at + step]
        whole = 4 * len(places) > cells.shape[1]
        if whole:  # cheaper than picking most of the rows
            partial = partial + (anchor[read] @ cells[read])[places]
        else:
            partial = partial + anchor[read] @ cells[np.ix_(read, places)]
        done = min(at + step, len(order))
        stays = keep(places, partial + rest[0][done], partial + rest[1][done])
        places, partial = places[stays], partial[stays]
    return places, partial.astype(np.int64)


def _top(scores: np.ndarray, count: int):
    """The `count`-th best of some scores, or None."""
    return np.partition(scores, len(scores) - count)[len(scores) - count] if len(scores) >= count else None


def _best(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the best rows: score falling, then id, then key."""
    return np.lexsort((keys, ids, -scores))[:count]


class _Held:
    """The best rows found so far for one goal of an anchor."""

    def __init__(self, count: int):
        self.count, self.ids, self.keys = count, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores: np.ndarray | None = None

    def add(self, block: Block, places: np.ndarray, scores: np.ndarray) -> None:
        ids, keys = (np.concatenate([a, b[places]]) for a, b in ((self.ids, block.ids), (self.keys, block.keys)))
        scores = scores if self.scores is None else np.concatenate([self.scores, scores])
        best = _best(ids, keys, scores, self.count)
        self.ids, self.keys, self.scores = ids[best], keys[best], scores[best]

    def known(self, more: np.ndarray):
        """A score that the wanted rows reach at least, given lower bounds of further rows."""
        scores = more if self.scores is None else np.concatenate([self.scores, more])
        return _top(scores, self.count)


def _positives(anchor: np.ndarray, key: int, label: int, block: Block, bounds: tuple, held: list[_Held],
               step: int) -> None:
    goal = held[0]

    def keep(_: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        known = goal.known(low)
        return np.ones(len(high), bool) if known is None else high >= known

    own = (block.labels == label) & (block.keys != key)
    goal.add(block, *scan(anchor, block.cells, *bounds, own, keep, step))


def _negatives(anchor: np.ndarray, windows: np.ndarray, label: int, block: Block, bounds: tuple,
               held: list[_Held], step: int) -> None:
    """`windows`: least and greatest score of each goal."""
    def keep(_: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for (a, b), goal in zip(windows, held):
            known = goal.known(low[(low >= a) & (high <= b)])  # of rows that are sure to be inside
            stays |= (low <= b) & (high >= (a if known is None else max(a, known)))
        return stays

    places, scores = scan(anchor, block.cells, *bounds, block.labels != label, keep, step)
    for (a, b), goal in zip(windows, held):
        inside = (scores >= a) & (scores <= b)
        goal.add(block, places[inside], scores[inside])


def _mined(stripe: pa.Table, group: pa.Table, goals: int, count: int, step: int) -> pa.Table:
    """The best rows of a stripe for each goal of each anchor of a group.

    `group` has anchors (key, id, label, x) and, in the second scan, `windows` (least and greatest
    score of each goal); without it there is one goal, the best rows of the anchor's label.
    """
    anchors = group.to_pylist()
    held = [[_Held(count) for _ in (a["windows"] if goals else [0])] for a in anchors]
    wide = max((abs(v) for a in anchors for v in a["x"]), default=0)
    for row in stripe.to_pylist():
        block = _unpacked(row)
        top = max(abs(int(block.cells.min(initial=0))), int(block.cells.max(initial=0)))
        # Sums of products that a double holds exactly, or whole numbers of any size.
        kind = np.float64 if top * wide * max(row["width"], 1) < _EXACT else object
        block = block._replace(cells=block.cells.astype(kind))
        bounds = block.cells.min(axis=1), block.cells.max(axis=1)
        for a, goal in zip(anchors, held):
            x = np.array(a["x"], kind)
            if goals:
                windows = [(w["least"], w["most"]) for w in a["windows"]]
                _negatives(x, windows, a["label"], block, bounds, goal, step)
            else:
                _positives(x, a["key"], a["label"], block, bounds, goal, step)
    out = [(a["key"], a["id"], k, int(key), int(i), int(s)) for a, own in zip(anchors, held)
           for k, g in enumerate(own) if g.scores is not None for key, i, s in zip(g.keys, g.ids, g.scores)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_key", "anchor_id", "goal", "key", "id", "score"]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


# --- All blocks against all anchors ---


def _paired(stored: DataFrame, anchors: DataFrame, stripes: int, groups: int, goals: int, count: int,
            step: int) -> DataFrame:
    """The best rows of each stripe for each anchor: each stripe meets each group once."""
    stripe = F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    left = stored.withColumn("stripe", stripe).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumns({"width": F.size("x"), "grp": group}).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    keys = ["width", "stripe", "grp"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _mined(a, b, goals, count, step)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """The best `count` rows of each goal over all stripes, with `rank`."""
    best = Window.partitionBy("anchor_key", "goal").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def _shares(number: int, least: int, size: int) -> int:
    """How many parts: `least`, or more where a part would be larger than `size`."""
    return max(least, -(-number // size))


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         scale: int = SCALE, block_rows: int = BLOCK_ROWS, step: int = STEP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for
    which `anchors` (a condition on `id`) holds."""
    spark = rows.sparkSession
    with cut_points(spark) as cut:
        usable = cut(whole_vectors(rows, key, vector, label, scale).withColumn(
            "key", F.monotonically_increasing_id()))
        stored = cut(blocks(usable, block_rows))
        asked = cut(usable.where(anchors))
        stripes = _shares(stored.count(), STRIPES, STRIPE_BLOCKS)
        groups = _shares(asked.count(), GROUPS, GROUP_ANCHORS)
        near = cut(_ranked(_paired(stored, asked, stripes, groups, 0, positives, step), positives))
        # 100 * score lies between shares of the positive's score: whole bounds, rounded inwards.
        least = -F.floor(-F.col("score").cast("decimal(30,0)") * LEAST_PERCENT / 100)
        most = F.floor(F.col("score").cast("decimal(30,0)") * MOST_PERCENT / 100)
        goals = near.select("anchor_key", F.struct(
            "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
            least.cast("long").alias("least"), most.cast("long").alias("most")).alias("goal"))
        wanted = cut(goals.where("goal.least <= goal.most").groupBy("anchor_key").agg(
            F.array_sort(F.collect_list("goal")).alias("windows")))
        second = cut(asked.join(wanted, F.col("key") == F.col("anchor_key")).drop("anchor_key"))
        found = _ranked(_paired(stored, second, stripes, groups, 1, negatives, step), negatives)
        goal = F.get("windows", F.col("goal"))
        named = found.join(wanted, "anchor_key").withColumn("positive", goal)
        none = lambda c: F.when(c < _NONE, c)
        return durable(named.select(
            "anchor_id", none(F.col("positive.positive_id")).alias("positive_id"), "rank",
            none(F.col("id")).alias("negative_id"), F.col("positive.positive_score").alias("positive_score"),
            F.col("score").alias("negative_score")))
