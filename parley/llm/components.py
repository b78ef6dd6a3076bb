"""Connected components of a graph given by its links, in DataFrame operations only.

Alternates two star contractions: every node hands its larger neighbours to its smallest one, then its smaller ones.
Rounds grow with the logarithm of the number of nodes; each costs a few shuffles of the links left, and is written to
the shared folder. No node's links are gathered: a minimum is taken with partial sums and joined back by ``lookup_join``,
which takes a hub's links out of the shuffle by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import discard, lookup_join, materialise


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _with_least(pairs: DataFrame, node: str, other: str, total: int) -> tuple[DataFrame, DataFrame]:
    """pairs and m, the least other end that each node has; and the table of these."""
    facts = materialise(pairs.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n")))
    return lookup_join(pairs, facts, node, "n", total), facts


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """node, root: for every node of a link, the smallest node it reaches. Null ends and self-links are left out."""
    pairs = links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), F.col(u).alias("u"), F.col(v).alias("v"))
    stars = materialise(pairs.where("u is not null and v is not null and a != b").select("a", "b").distinct())
    state = _state(stars)
    while state[0]:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, first = _with_least(both, "u", "v", 2 * state[0])
        large = materialise(least.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())
        lowest, second = _with_least(large, "a", "b", large.count())
        small = lowest.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.where("b = m").select("a", "b"))
        small = materialise(small.distinct())
        after = _state(small)
        discard(stars, first, large, second)
        stars = small
        if after == state:
            break
        state = after
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
