"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import counted


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u and all its neighbours.

    The minimum is pre-aggregated, then joined back, so that a node with very many neighbours
    is neither collected nor held by one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): for each row of edges (u, v, m), the named pairs of columns."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return edges.select(F.explode(each).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component; edges has columns u and v.

    Alternating large-star and small-star rounds, each cut into the shared folder, until the
    edges no longer change. The number of rounds grows with the logarithm of the nodes.
    """
    marks = (F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003))
    now, state = counted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *marks)
    last = None
    for _ in range(max_rounds):
        if state == last or not state[0]:
            break
        last = state
        large = _star(_pairs(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now, state = counted(_pairs(_star(large), ("v", "m"), ("u", "m")).where("u <> v").distinct(), *marks)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return _pairs(now, ("u", "v"), ("v", "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
