"""Connected groups of links as DataFrame rounds; nothing is gathered on the driver or in one task."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordframe.cluster import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: every node of ``links`` with the smallest node of its connected group.

    In each round every node goes to the first of itself and its neighbours, in an order that a hash draws anew, and the links
    are drawn again between where their ends went, without those that have become loops or one. So the links
    become fewer with every round and the rounds end when none is left. Links to a
    node itself and repeated links do no harm; null ends are ignored; no links give no rows.
    """
    ends = cut(links.select(F.least(a, b).alias("node"), F.greatest(a, b).alias("other")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    moves = []
    while not moves or ends.head(1):
        both = ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other")))
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("to"))      # noqa: E731
        moved = cut(both.groupBy("node").agg(F.min(place("other")).alias("low"))
                    .select("node", F.least("low", place("node"))["to"].alias("to")))
        moves.append(moved)
        half = ends.where("node < other").join(moved.withColumnRenamed("to", "x"), "node")
        ends = cut(half.join(moved.select(F.col("node").alias("other"), F.col("to").alias("y")), "other")
                   .where("x <> y").select(F.least("x", "y").alias("node"), F.greatest("x", "y").alias("other")).distinct())
    last = moves.pop()
    for earlier in reversed(moves):
        beyond = last.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        last = earlier.join(beyond, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
    # Written, so that a group that many nodes share can be split between tasks of the join.
    last = cut(last)
    return cut(last.join(last.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root"))
