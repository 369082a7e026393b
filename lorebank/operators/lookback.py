"""The n rows before each row of a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4_096


def preceding_rows(df: DataFrame, group: list[str], order: str, item: Column, n: int, name: str, bucket: int = BUCKET_ROWS) -> DataFrame:
    """Add an array of ``item`` of the up to ``n`` rows before each row, oldest first.

    ``order`` is a non-negative integer, unique inside the group. A group is cut into value ranges of
    ``bucket``, each a sort of its own, so a conversation with a third of all turns spreads over many
    tasks. A range starts with the last ``n`` rows before it, taken from the (at most ``n`` row) tails
    of the ranges in front; only those tails meet per group.
    """
    cut = df.withColumns({"_bucket": F.floor(F.col(order) / bucket), "_item": item})
    keys = [*group, "_bucket"]
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    tails = (
        cut.select(*keys, order, "_item")
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(order, "_item"))).alias("_tail"))
    )
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(-n, -1)
    joined = F.flatten(F.collect_list("_tail").over(earlier))
    carried = tails.withColumn("_joined", joined).where(F.size("_joined") > 0).withColumn(
        "_carry", F.slice("_joined", F.greatest(F.size("_joined") - n + 1, F.lit(1)), n)
    )
    # rows carried in front of a range have no columns but their item
    rest = [c for c in df.columns if c not in (*group, order)]
    front = carried.select(*keys, F.inline("_carry")).select(
        *keys, order, "_item", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest], F.lit(True).alias("_front")
    )
    rows = cut.select(*keys, order, "_item", *rest, F.lit(False).alias("_front"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return (
        rows.unionByName(front)
        .withColumn(name, F.collect_list("_item").over(before))
        .where(~F.col("_front"))
        .select(*df.columns, name)
    )
