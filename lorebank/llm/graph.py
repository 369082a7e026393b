"""Connected components by alternating star contraction, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import stored


def _hang_on_minimum(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smallest v of each u beside them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(low, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node of its component.

    Null ends and self-loops are ignored, repeated edges count once. Every round is a table in the
    shared folder; what reaches the driver is one row count and checksum per round. Node lists are never gathered: a hub of
    any degree is a grouped minimum with map-side combine and a join that adaptive execution can split.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = stored(e, "edges")
    state = _fingerprint(e)
    while state[0]:
        # every larger neighbour of u moves to the smallest neighbour of u (or to u itself)
        both = e.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _hang_on_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        # u and its smaller neighbours move to the smallest of them
        low = _hang_on_minimum(large)
        moved = low.select(F.inline(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))))
        e = stored(moved.where("u != v").distinct(), "edges")
        state, before = _fingerprint(e), state
        if state == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _fingerprint(e: DataFrame) -> tuple:
    """Size of an edge table and an order-free checksum."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
