"""Documents whose sets of word n-grams are alike, by blocked products of document by n-gram.

Words are A-Z lower-cased runs between ASCII white space; a document's set holds its distinct
shingles of SHINGLE words (a shorter text is one shingle). Documents link when `percent` of the
union of their sets is in both. The result is exact, up to equal 64-bit digests of different
shingles within one comparison:

1. Documents with equal sets are one class (128-bit digests of the sets); the smallest id stands
   for it. Copies cost nothing further.
2. Shingles are ordered from rare to frequent, frequencies being counted over all classes for a
   part of the shingle space (the rest follows in digest order, without counting). Two sets that
   link share one of the first n - ceil(percent n) + 1 shingles of both, so only those make
   candidates; boilerplate shared by many documents is at the end of the order and makes none.
3. Sizes of linked sets are within `percent` of each other, so candidates meet by shingle and
   band of size. Candidates that reach each other form a group.
4. In each group all sets are compared with one hub, the set with the fewest shingles of its own:
   near copies of one original are linked in one pass, however many there are.
5. Sets that the hub does not reach (open ones) are compared with the others of their group by
   blocks: overlaps are counted by products of block incidence matrices, pairs below the bound
   that follows from their sizes are dropped, and each task returns a spanning forest of the
   links, never all pairs. Blocks hold about BLOCK shingles; block pairs without a common candidate
   shingle are not compared.
6. Components of hub links and block links.

Null, empty and blank texts have empty sets and link with nothing. Rows without an id link with
nothing and get no component. Repeated rows count once. Of rows
that share an id but not the text one text stands for the id in links; the others are only put together
with equal sets. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.common import FlatWords, if_small, mix, slices
from tallymill.llm.components import components
from tallymill.session import cut_points, durable

SHINGLE = 4
PERCENT = 85
BLOCK = 120_000
BLOCK_SETS = 4_096
TILE = 1 << 20
DENSE = 64
CHUNK = 2_048
Cut = Callable[[DataFrame], DataFrame]
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64))
SET_SCHEMA = ("doc_id long, n int, sig1 long, sig2 long, prefix int, counted int, "
              "tokens array<long>")


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct digests of all texts, one text after the other; how many each has)."""
    words = FlatWords(texts)
    hashes, n = words.hashes(), words.counts
    text = words.text_of_word()
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        total[:len(hashes) - k] += hashes[k:] * _FACTORS[k]
    place = np.arange(len(hashes)) - words.first[:-1][text]
    whole = place + size <= n[text]
    shingles, owner = mix(total[whole]), text[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        brief = [int(np.sum(hashes[words.first[i]:words.first[i + 1]] * _FACTORS[size:size + n[i]]))
                 for i in short]
        shingles = np.concatenate([shingles, mix(np.array(brief, np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(n))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def counted_below(percent: int) -> int:
    """Digests below this are counted: five thirds of the share of shingles that a prefix takes,
    so that a set may be boilerplate for two fifths and still have a prefix without any."""
    return min(2 ** 63 - 1, 2 ** 64 * 5 * (100 - percent) // 300)


def signatures(values: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two digests of each set that do not depend on the order of its shingles."""
    ends = np.cumsum(n)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values + f))]) for f in _FACTORS[-2:]]
    return [mix(s[ends] - s[ends - n] + n.astype(np.uint64)).view(np.int64) for s in sums]


def sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: set size, digests of the set, and its smallest shingle digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, n = shingle_sets(part.column("text"), size)
                ends, sig = np.cumsum(n), signatures(values, n)
                prefix = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                below = np.concatenate([[0], np.cumsum(values < np.uint64(counted_below(percent)))])
                counted = below[ends] - below[ends - n]
                kept = np.maximum(prefix, counted)
                place = np.arange(len(values)) - np.repeat(ends - n, n)
                tokens = _lists(values[place < np.repeat(kept, n)], kept)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n, pa.int32()), *map(pa.array, sig),
                    pa.array(prefix, pa.int32()), pa.array(counted, pa.int32()), tokens],
                    ["doc_id", "n", "sig1", "sig2", "prefix", "counted", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SET_SCHEMA)


def candidates(found: DataFrame, classes: DataFrame, percent: int, cut: Cut) -> DataFrame:
    """(key, rep, n, uniq, frequency, token): where classes may meet, written.

    `uniq` counts a set's own shingles: the counted ones that no other class has.
    """
    tokens = found.join(if_small(classes.select(F.col("rep").alias("doc_id"), "sig1", "sig2")),
                        ["doc_id", "sig1", "sig2"]).select(
        F.col("doc_id").alias("rep"), "n", "prefix", "counted", F.explode("tokens").alias("token"))
    frequencies = cut(tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("frequency")).where("frequency > 1"))
    shared = tokens.join(frequencies, "token")
    own = Window.partitionBy("rep")
    tail = ~F.col("token").between(0, counted_below(percent) - 1)
    shared = shared.withColumns({
        "uniq": F.col("counted") - F.sum(F.when(tail, 0).otherwise(1)).over(own),
        "place": F.row_number().over(own.orderBy(tail, "frequency", "token"))})
    # Shingles of its own come first in a set's order and meet nobody. Uncounted ones all stay.
    first = shared.where(tail | (F.col("place") <= F.col("prefix") - F.col("uniq")))
    band = F.floor(F.log("n") / -math.log(percent / 100 - 1e-6)).cast("int")
    keys = F.transform(F.array(band, band + 1), lambda b: F.xxhash64("token", b))
    return cut(first.select(F.explode(keys).alias("key"), "rep", "n", "uniq", "frequency", "token"))


def groups(meeting: DataFrame, cut: Cut) -> DataFrame:
    """(rep, grp, uniq, home, n): classes that reach each other over candidates, written."""
    leaders = cut(meeting.groupBy("key").agg(
        F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").drop("last"))
    found = components(meeting.join(leaders, "key").select(F.col("rep").alias("a"), "b"))
    about = meeting.groupBy("rep").agg(
        F.min("uniq").alias("uniq"), F.min("n").alias("n"),
        F.min_by("token", F.struct("frequency", "token")).alias("home"))
    return cut(found.select(F.col("id").alias("rep"), F.col("component").alias("grp")).join(
        about, "rep"))


def member_sets(docs: DataFrame, classes: DataFrame, grouped: DataFrame, size: int,
                cut: Cut) -> DataFrame:
    """The whole sets of grouped classes, written."""
    wanted = cut(grouped.join(classes, "rep"))
    carried = ["rep", "grp", "uniq", "n", "home"]
    schema = ("rep long, grp long, uniq int, n int, home long, shingles array<long>, "
              "right boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, n = shingle_sets(part.column("text"), size)
                # A row that shares the id has another text.
                right = [a == part.column(c).to_numpy() for a, c in zip(
                    signatures(values, n), ("sig1", "sig2"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), _lists(values, n), pa.array(right[0] & right[1])],
                    [*carried, "shingles", "right"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(if_small(wanted), "rep")
    found = rows.select(*carried[:2], F.col("uniq").cast("int").alias("uniq"), *carried[3:], "sig1",
                        "sig2", "text").mapInArrow(run, schema)
    return cut(found.where("right").drop("right"))


def hub_links(members: DataFrame, percent: int, cut: Cut) -> DataFrame:
    """(rep, grp, hub, linked): every member against its group's hub, written."""
    hubs = cut(members.groupBy("grp").agg(F.min(F.struct("uniq", "rep")).alias("least")).select(
        "grp", F.col("least.rep").alias("hub")))
    whole = members.join(hubs, (members["grp"] == hubs["grp"]) & (members["rep"] == hubs["hub"])).select(
        hubs["grp"], "hub", F.col("n").alias("hub_n"), F.col("shingles").alias("hub_shingles"))
    both = F.size(F.array_intersect("shingles", "hub_shingles"))
    joined = members.join(cut(whole), "grp").select(
        "rep", "grp", "hub", "n", "hub_n", both.alias("both"))
    return cut(joined.select("rep", "grp", "hub", (
        F.col("both") * 100 >= (F.col("n") + F.col("hub_n") - F.col("both")) * percent).alias("linked")))


def _incidence(owner: np.ndarray, token: np.ndarray, sets_: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, place in `sets_`) of the shingles of some sets, by token and place."""
    place = np.full(n, -1)
    place[sets_] = np.arange(len(sets_))
    on = place[owner] >= 0
    order = np.lexsort((place[owner[on]], token[on]))
    return token[on][order], place[owner[on]][order]


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], height: int,
             width: int) -> np.ndarray:
    """Shingles in both, for each of `height` sets and each of `width`: a sparse product.

    Most shingles stand in few sets: their pairs are listed and counted, TILE at a time. Shingles that
    fill more than a part of the product of DENSE are multiplied as full columns, CHUNK at a time.
    """
    out = np.zeros((height, width), np.float32)
    (a_token, a_place), (b_token, b_place) = left, right
    first, behind = (np.searchsorted(b_token, a_token, side=x) for x in ("left", "right"))
    times = behind - first
    own = np.searchsorted(a_token, a_token, side="right") - np.searchsorted(a_token, a_token)
    dense = times * own * DENSE > height * width
    for low in range(0, len(heavy := np.unique(a_token[dense])), CHUNK):
        some = heavy[low:low + CHUNK]
        sides = []
        for token, place, size in ((a_token, a_place, height), (b_token, b_place, width)):
            column = np.minimum(np.searchsorted(some, token), len(some) - 1)
            on = some[column] == token
            side = np.zeros((size, len(some)), np.float32)
            side[place[on], column[on]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    light = ~dense & (times > 0)
    first, times, a_place = first[light], times[light], a_place[light]
    ends = np.cumsum(times)
    cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + TILE, TILE))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            size = times[a:b]
            shift = np.repeat(first[a:b] - (np.cumsum(size) - size), size)
            cells = np.repeat(a_place[a:b] * width, size) + b_place[np.arange(len(shift)) + shift]
            out += np.bincount(cells, minlength=height * width).reshape(height, width)
    return out


def forest(shingles: pa.ChunkedArray | pa.Array, n: np.ndarray, rows: np.ndarray, columns: np.ndarray,
           percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the sets `rows` and the sets `columns`.

    Some rows meet all columns at a time, so that a matrix has about TILE cells at most.
    """
    flat = shingles.combine_chunks() if isinstance(shingles, pa.ChunkedArray) else shingles
    values = flat.flatten().to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    _, token, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    right = _incidence(owner, token, columns, len(n))
    # Whole numbers are exact in 32 bits up to 2 ** 24.
    exact = np.float32 if n.max(initial=0) * 200 < 1 << 24 else np.float64
    sizes = n.astype(exact)
    found = []
    step = max(1, TILE // max(1, len(columns)))
    for low in range(0, len(rows), step):
        some = rows[low:low + step]
        overlap = overlaps(_incidence(owner, token, some, len(n)), right, len(some), len(columns)).astype(
            exact, copy=False)
        union = sizes[some][:, None] + sizes[columns][None, :] - overlap
        linked = overlap * exact(100) >= union * exact(percent)
        if not linked.any():
            continue
        label = np.arange(len(n), dtype=np.int32)
        while True:
            before = label.copy()
            for here, there, matrix in ((some, columns, linked), (columns, some, linked.T)):
                least = np.where(matrix, label[there][None, :], np.int32(len(n))).min(1, initial=len(n))
                label[here] = np.minimum(label[here], least)
            label = label[label]
            if (label == before).all():
                break
        joined = np.flatnonzero(label != np.arange(len(n)))
        found.append((joined, label[joined]))
    return _joined(found, len(n))


def _joined(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One forest of several: each of `n` places that is not the first of its tree, and the first."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(after, ends, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


def part_links(part: pa.Table, percent: int) -> pa.Table:
    """(a, b): a spanning forest of one pair of blocks, whatever order its rows come in."""
    part = part.sort_by("rep")
    n = part.column("n").to_numpy().astype(np.int64)
    rep = part.column("rep").to_numpy()
    block, is_open = part.column("block").to_numpy(), part.column("open").to_numpy()
    one = part.column("b1")[0].as_py() == part.column("b2")[0].as_py()
    edges = []
    for mine in [block == block] if one else [block == b for b in np.unique(block)]:
        rows, columns = np.flatnonzero(mine & is_open), np.flatnonzero(mine if one else ~mine)
        if len(rows) and len(columns):
            a, b = forest(part.column("shingles"), n, rows, columns, percent)
            edges.append((rep[a], rep[b]))
    a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def block_links(members: DataFrame, hubs: DataFrame, meeting: DataFrame, percent: int,
                cut: Cut) -> DataFrame:
    """(a, b): links of the sets that no hub reached with the others of their group."""
    status = hubs.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max(~F.col("linked")).alias("any"))
    unfinished = cut(status.where("any and size > 2").select("grp"))
    rest = members.join(if_small(unfinished), "grp").join(
        hubs.where("rep <> hub").select("rep", (~F.col("linked")).alias("open")), "rep")
    light = cut(rest.select("rep", "grp", "n", "home", "open"))
    # Large groups are cut by the rarest candidate shingle, and a part that is still large at random.
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("n") / BLOCK_SETS))
    many = light.groupBy("grp").agg(blocks.alias("parts"))
    placed = light.join(many, "grp").withColumn(
        "part", F.expr("pmod(xxhash64(home), parts)"))
    pieces = placed.groupBy("grp", "part").agg(blocks.alias("pieces"))
    placed = cut(placed.join(pieces, ["grp", "part"]).select(
        "rep", "grp", "open", F.xxhash64(
            "part", F.expr("pmod(xxhash64(rep), pieces)")).alias("block")))
    seen = cut(meeting.select("key", "rep").join(placed, "rep").groupBy("key", "grp", "block").agg(
        F.max("open").alias("open")))
    other = seen.select("key", F.col("block").alias("block2"), F.col("open").alias("open2"))
    pairs = seen.join(other, "key").where(
        (F.col("block") <= F.col("block2")) & (F.col("open") | F.col("open2"))).select(
        "grp", F.col("block").alias("b1"), F.col("block2").alias("b2")).distinct()
    pairs = cut(pairs)
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("b1", "b2"))))
    tasks = members.select("rep", "n", "shingles").join(placed, "rep").join(sides, ["grp", "block"])

    def run(part: pa.Table) -> pa.Table:
        return part_links(part, percent)

    return tasks.groupBy("grp", "b1", "b2").applyInArrow(run, "a long, b long")


def repeated_ids(docs: DataFrame, cut: Cut) -> DataFrame:
    return cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))


def without_repeated_rows(docs: DataFrame, columns: list[str], cut: Cut) -> DataFrame:
    """`docs` with one of each rows alike in id and `columns`. Only rows whose id is repeated are
    shuffled."""
    ids = repeated_ids(docs, cut)
    if ids.isEmpty():
        return docs
    return docs.join(if_small(ids), "doc_id", "left_anti").unionByName(
        docs.join(if_small(ids), "doc_id", "left_semi").dropDuplicates(
            ["doc_id", *columns]))


def linked_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                     signed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, written; what was written on the way goes.

    With `signed`, also the digests of its set (sig1, sig2).
    """
    with cut_points(docs.sparkSession) as cut:
        found = cut(sets(docs, size, percent))
        classes = cut(found.where("n > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(
            F.min("doc_id").alias("rep")))
        # An id stands for one set only.
        standing = cut(classes.groupBy("rep").agg(F.min(F.struct("sig1", "sig2")).alias("sig")).select(
            "rep", "sig.*"))
        once = without_repeated_rows(found, ["sig1", "sig2"], cut)
        meeting = candidates(once, standing, percent, cut)
        grouped = groups(meeting, cut)
        texts = without_repeated_rows(docs.select("doc_id", "text"), ["text"], cut)
        members = member_sets(texts, standing, grouped, size, cut)
        hubs = hub_links(members, percent, cut)
        links = hubs.where("linked").select(F.col("rep").alias("a"), F.col("hub").alias("b")).union(
            block_links(members, hubs, meeting, percent, cut))
        reached = standing.join(components(links), F.col("rep") == F.col("id")).select(
            "sig1", "sig2", "component")
        of_class = cut(classes.join(reached, ["sig1", "sig2"], "left").select(
            "sig1", "sig2", F.coalesce("component", "rep").alias("component")))
        kind = docs.schema["doc_id"].dataType
        return durable(found.join(if_small(of_class), ["sig1", "sig2"], "left").select(
            F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).cast(kind).alias(
                "component_id"), *(["sig1", "sig2"] if signed else [])))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component; one row for each id and set.

    Rows without an id stay, and rows without words, once for each id and text. Rows that share an id
    but not the set are judged each by its own set; of rows alike in id and set one text stays.
    """
    linked = linked_documents(docs, size, percent, signed=True).where("doc_id is not null")
    flags = durable(linked.groupBy(F.col("doc_id").alias("__id")).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.min(F.col("component_id") != F.col("doc_id")).alias("__gone")).where("__rows > 1 or __gone"))
    marked = docs.join(if_small(flags), F.col("doc_id") == F.col("__id"), "left")
    kept = marked.where("__id is null")
    if not flags.where("__rows > 1").isEmpty():
        shared = marked.where("__rows > 1").withColumn("__key", F.xxhash64("doc_id", "text"))
        texts = shared.select("__key", "doc_id", "text").dropDuplicates(["__key"])
        own = sets(texts.select(F.col("__key").alias("doc_id"), "text"), size, percent).select(
            F.col("doc_id").alias("__key"), "n", "sig1", "sig2").join(
            texts.select("__key", "doc_id"), "__key")
        staying = linked.where("component_id = doc_id").select("doc_id", "sig1", "sig2").distinct()
        # Texts without words stay apart.
        apart = F.when(F.col("n") == 0, F.col("__key"))
        keys = durable(own.join(staying, ["doc_id", "sig1", "sig2"]).groupBy(
            "doc_id", "sig1", "sig2", apart).agg(F.min("__key").alias("__key")).select("__key"))
        kept = kept.unionByName(shared.join(if_small(keys), "__key", "left_semi").dropDuplicates(
            ["__key"]).drop("__key"))
    return kept.select(*docs.columns)
