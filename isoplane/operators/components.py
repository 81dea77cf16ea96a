"""Connected components by alternating star contraction.

Each round rewires every node to the smallest node it can see: the *large star* moves a node's larger neighbours onto its
smallest one, the *small star* does the same for its smaller neighbours.  The edge list never grows beyond its first
size, converges in a number of rounds that is logarithmic in practice, and ends as one star per component.  Rounds end
in a reliable checkpoint, so neither lineage nor executor loss matters; nothing but two numbers per round reaches the
driver.  The joins are salted, as stars are what the rounds make: a hub's edges are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut


#: Parts that a node's edges are dealt to in a join.
SALT = 16


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour ``m`` of their node ``a``; a hub's edges go to ``SALT`` tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    every = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(every, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_low(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_low(down, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node with an edge; ``root`` is the smallest node of its component.

    Null ends, self loops and repeated edges are ignored (a node with only self loops is not returned).  An empty
    input gives an empty result.  ``max_rounds`` guards against a bug only: reaching it raises, it never truncates.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
