"""Connected components of a graph of any size, as DataFrames.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"). A node with very many neighbours is never
gathered in one task: its minimum is aggregated map-side first, and is handed
back to its edges by a join salted with the neighbours' own hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, drop

SALTS = 64


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours in edges."""
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = edges.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    least = least.select(
        "u",
        "m",
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1L) = 1L)")).alias("salt"),
    )
    return edges.join(least, ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its least node.

    Self-loops, repeated edges and both directions are fine. Null ends are ignored.
    """
    e = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )
    table = first = cut(e)
    loops = first.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    e = first.where("u > v")
    done = False
    while not done:
        both = e.select(F.expr("inline(array(struct(u, v), struct(v AS u, u AS v)))"))
        # every half round is cut: its result is read twice
        large = cut(_with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_minimum(large).select(F.expr("inline(array(struct(u, m AS v), struct(v AS u, m AS v)))"))
        e = cut(small.where("u > v").distinct())
        drop(large, *([table] if table is not first else []))
        table = e
        # stars are all that is left once every u has one v and no v is a u
        ends = e.select(F.expr("inline(array(struct(u AS node, 1 AS below), struct(v AS node, 0 AS below)))"))
        ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
        done = ends.where("below > 1 OR (below = 1 AND least = 0)").limit(1).count() == 0
    stars = e.select(F.expr("inline(array(struct(u AS node, v AS component), struct(v AS node, v AS component)))"))
    return stars.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
