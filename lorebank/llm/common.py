"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.session import shared_dir

#: ASCII white space, the separator of words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, UPPER, UPPER.lower())


def n_words(col: Column) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names, each once, with all columns of ``docs``.

    ``kept`` has ``doc_id`` and ``key``; ``key`` computes the same value from a row of ``docs``. Rows that
    share both (repeated rows) are one entry: the smallest by the hash of all columns stays. Only when ``kept`` says
    by a count above 1 in ``n_same`` that such rows exist are they grouped; else texts are shuffled once, for the join.
    """
    name, other, ident = fresh(docs, "lb_key"), fresh(docs, "lb_other"), fresh(docs, "lb_id")
    names = kept.select(F.col("doc_id").alias(ident), F.col("key").alias(other), "n_same")
    rows = docs.withColumn(name, key)
    out = rows.join(names.drop("n_same"), rows["doc_id"].eqNullSafe(names[ident]) & (rows[name] == names[other]), "left_semi")
    if (names.agg(F.max("n_same")).first()[0] or 0) > 1:
        row = F.struct(*[F.col(c) for c in docs.columns])
        one = out.groupBy("doc_id", name).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
        return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return out.select(*docs.columns)
