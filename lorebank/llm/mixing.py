"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

The words of all sources are shared out by weight; a source takes at most ``MOST`` times its own words, and what it
cannot take is shared again by weight (water filling). Inside a source each document has expected copies
``e = min(MOST, c * u)``: ``u`` grows slowly with the document's size class (``TILT``), ``c`` is set so
that the expected words equal the target. ``floor(e)`` whole copies are certain. The fraction ``p`` of e left is an inclusion
probability: documents are ranked by ``(U / (1 - U)) / (p / (1 - p))``, their random odds divided by their
inclusion odds, and taken in this order until the source's sample has the words still due. The sample size is
thus fixed in words; the last document is taken if that brings the sum nearer, so a source misses its target by half a document at most.

``U`` comes from a hash of seed and doc_id, so reruns agree. The rank within a source is found in two steps, a
histogram of rank buckets and then the rows of one bucket only, so no source is sorted in one task.

Defined cases: null text has no words and is taken 0; a null source is a source of its own, the last; rows that repeat
are separate documents of equal rank, ordered by size; an empty table gives no rows; sources without words have target 0; very long texts are counted
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebank.llm.common import fresh, n_words, stored

#: A document or source is taken at most this many times.
MOST = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: ``u = TILT + size class``: the larger, the nearer the inclusion odds of short and long documents.
TILT = 32
#: Rank buckets per source; each is one task's share of a source at most.
RANKS = 4096
SEED = "mix-1"


def uniform(ident: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by the id: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def size_class(size: Column) -> Column:
    """Number of binary digits of the size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Sources in order of source_size / weight reach their ceiling first; with k of them at the ceiling the level of the
    rest is (total - ceilings) / weights left, and the smallest consistent k is the fixed point of sharing again and again.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    below = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("source_size").over(below), F.lit(0)) * MOST,
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
    })
    level = (F.col("total") - F.col("full")).cast("double") / F.col("open")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("source_size") * MOST, level))
    level = F.max("level").over(everything)  # later prefixes fit too, at ever lower levels
    target = F.least((F.col("source_size") * MOST).cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _class_copies(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Expected copies ``e`` per source and size class, so that a source's expected words equal its target.

    The same filling as for sources, over at most 64 classes of a source: high classes reach ``MOST`` first.
    """
    c = classes.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    c = c.withColumn("u", F.col("class") + TILT)
    above = Window.partitionBy("source").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source")
    used = F.coalesce(F.sum("words").over(above), F.lit(0)) * MOST
    left = F.sum(F.col("words") * F.col("u")).over(own) - F.coalesce(F.sum(F.col("words") * F.col("u")).over(above), F.lit(0))
    rate = (F.col("target") - used) / left
    c = c.withColumn("rate", F.when((left > 0) & (rate * F.col("u") <= MOST), rate))
    # rates that fit come with ever fewer classes at the ceiling; the first of them is the largest class's
    best = F.coalesce(F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("class"))).over(own), F.lit(float(MOST)))
    copies = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), best * F.col("u")))
    return c.select("source", "class", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, inclusion, times, taken`` per row of ``docs``."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = stored(rows.withColumns({"class": size_class(F.col("size")), "uniform": uniform(F.col("doc_id"), seed)}), "mix-sizes")
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights).withColumnRenamed("source", "target_source")
    plan = stored(_class_copies(classes, targets), "mix-plan")  # sources x 64 rows at most

    plan = plan.withColumnsRenamed({"source": "plan_source", "class": "plan_class"})
    fits = rows["source"].eqNullSafe(plan["plan_source"]) & (rows["class"] == plan["plan_class"])
    part = rows.join(plan, fits).drop("plan_source", "plan_class")
    part = part.withColumns({"certain": F.floor("copies"), "inclusion": F.col("copies") - F.floor("copies")})
    p, u = F.col("inclusion"), F.col("uniform")
    # the rank as a share: odds / (1 + odds) lies in (0, 1) and keeps the order
    odds = (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)
    part = stored(part.withColumn("rank", F.when(p > 0, odds)).withColumn("bucket", F.floor(F.col("rank") * RANKS)), "mix-ranks")

    drawn = part.where("rank is not null")
    due = part.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    due = due.select(F.col("source").alias("due_source"), (F.col("target") - F.col("sure")).alias("due"))
    filled = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    filled = filled.join(due, F.col("source").eqNullSafe(F.col("due_source")))
    # a bucket is taken whole, not at all, or row by row where the words due end in it
    state = F.when(F.col("before") + F.col("words") <= F.col("due"), 2).when(F.col("before") < F.col("due"), 1).otherwise(0)
    filled = stored(filled.select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), "before", "due", state.alias("state")), "mix-buckets")
    met = part["source"].eqNullSafe(filled["at_source"]) & (part["bucket"] == filled["at_bucket"])
    placed = part.join(filled, met, "left").drop("at_source", "at_bucket")

    edge = Window.partitionBy("source", "bucket").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.where("state = 1").withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
    inner = inner.withColumn("extra", (F.col("sofar") + F.col("size") / 2 <= F.col("due")).cast("long")).drop("sofar")
    outer = placed.where("state is null or state <> 1").withColumn("extra", F.coalesce((F.col("state") == 2).cast("long"), F.lit(0)))
    times = F.col("certain") + F.col("extra")
    out = outer.unionByName(inner).withColumns({"times": times, "taken": times * F.col("size")})
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "inclusion", "times", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    The decision joins by id, source and size. Repeated rows that share all three are taken by their sum of times, dealt evenly.
    """
    names = {c: fresh(docs, f"lb_{c}") for c in ("id", "source", "size", "times", "n", "k")}
    chosen = mix(docs, weights, seed).groupBy("doc_id", "source", "size").agg(F.sum("times").alias(names["times"]), F.count("*").alias(names["n"]))
    chosen = stored(chosen.where(F.col(names["times"]) > 0).withColumnsRenamed({"doc_id": names["id"], "source": names["source"], "size": names["size"]}), "mix-chosen")
    rows = docs.withColumn(names["k"], n_words(F.col("text")))
    same = rows["doc_id"].eqNullSafe(chosen[names["id"]]) & rows["source"].eqNullSafe(chosen[names["source"]]) & (rows[names["k"]] == chosen[names["size"]])
    out = rows.join(chosen, same)
    if (chosen.agg(F.max(names["n"])).first()[0] or 0) > 1:
        order = Window.partitionBy(names["id"], names["source"], names["size"]).orderBy(F.xxhash64(*docs.columns))
        out = out.withColumn(names["k"], F.row_number().over(order) - 1)
    else:
        out = out.withColumn(names["k"], F.lit(0))
    share = F.floor((F.col(names["times"]) + F.col(names["n"]) - 1 - F.col(names["k"])) / F.col(names["n"]))
    return out.withColumn(names["k"], F.explode(F.array_repeat(F.lit(0), share.cast("int")))).select(*docs.columns)
