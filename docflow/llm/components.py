"""Connected components by alternating large-star and small-star steps.

Both steps are a grouped minimum (combined before the shuffle) and a join back on the node, so a
node with very many links is a skewed join, which adaptive execution splits, and never a collected
group. Every round is written to the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _facts(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a, b of any one ordered type).

    component is the smallest node reachable. Loops, repeated rows and either direction are fine;
    rows with a null end are no links. An empty table gives an empty table.
    """
    live = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = scratch.keep(live, "edges")
    facts, before = _facts(kept), None
    # Each step keeps the components and lowers the sum of all ends until nothing changes, so this ends.
    while facts[0] and facts != before:
        both = kept.union(kept.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = step.union(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.keep(step, "edges")
        before, facts = facts, _facts(new)
        scratch.drop(kept)
        kept = new
    roots = kept.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return kept.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
