"""Connected components of links, by contraction: joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import cut_points, durable

# A node follows the pointers of so many nodes in one round.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `links` (a, b: long).

    Nodes are named by the digest of their id (different for different ids: xxhash64 maps 64 bits
    one to one), so their order is random and chains of falling names are short. In each round a node
    points to the least of its neighbours and itself, and on to where that one points. Links are then
    drawn between the nodes pointed to, each once, and those within one node go, so nodes and links
    become fewer from round to round. Rounds end when no link is left; their pointers are followed
    from first to last, and each component gets its smallest id. Grouped minima are combined before
    the shuffle; a node with very many links is split by the joins. Pointers and links of each round
    are written, so a lost executor costs one round at most. The result is written, the rounds go.

    Links are computed once and written before they are mirrored: a second computation may choose
    other ones (another spanning forest of the same parts), and a link without its mirror loses nodes.
    """
    links = links.where("a is not null and b is not null and a <> b")
    with cut_points(links.sparkSession) as cut:
        given = cut(_each_once(links, F.col("a"), F.col("b")))
        left = given.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
        rounds = []
        while not rounds or not left.isEmpty():
            both = left.union(left.select("b", "a"))
            least = both.groupBy(F.col("a").alias("id")).agg(
                F.least(F.min("b"), F.col("id")).alias("root"))
            pointers = least
            for _ in range(JUMPS):
                pointers = pointers.join(_renamed(least, "root", "next"), "root").select(
                    "id", F.col("next").alias("root"))
            rounds.append(cut(pointers))
            drawn = left.join(_renamed(rounds[-1], "a", "x"), "a").join(
                _renamed(rounds[-1], "b", "y"), "b")
            left = cut(_each_once(drawn.where("x <> y"), F.col("x"), F.col("y")))
        found = rounds.pop()
        for before in reversed(rounds):
            found = before.join(_renamed(found, "root", "next"), "root", "left").select(
                "id", F.coalesce("next", "root").alias("root"))
        ids = given.select("a").union(given.select("b")).distinct()
        rooted = cut(ids.join(found, F.xxhash64("a") == F.col("id")).select(F.col("a").alias("id"), "root"))
        smallest = rooted.groupBy("root").agg(F.min("id").alias("component"))
        return durable(rooted.join(smallest, "root").select("id", "component"))


def _each_once(links: DataFrame, a: Column, b: Column) -> DataFrame:
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _renamed(pointers: DataFrame, id: str, root: str) -> DataFrame:
    return pointers.select(F.col("id").alias(id), F.col("root").alias(root))
