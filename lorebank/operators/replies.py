"""Model replies as JSON text: cut out, parsed to VARIANT, read into typed rows with the leniency of the reply contract.

A reply may have text around its outermost ``{…}``. Fields are read by truth: a missing, null, false, zero or empty value is an empty text; numbers and
``true`` are taken as text; lists and objects are no text. ``insufficient`` is whatever counts as true. Citations count only as a list; ids follow
the rule of texts, a quote must be a string. A reply that is no JSON is flagged ``bad`` and has no fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.functions.columns import let
from lorebank.functions.text import first_json_object

_NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_ITEM = "array<struct<pos:int,chunk_id:string,note_id:string,quote:string>>"


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def truth_of(v: Column) -> Column:
    """Whether a variant counts as true."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.rlike(_NUMBERS), F.try_variant_get(v, "$", "double") != 0)
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.lit(True)),
        F.lit(False),
    )


def text_of(v: Column) -> Column:
    """A variant as text: empty unless it is a true string, number or boolean."""
    plain = ~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
    return F.when(truth_of(v) & plain, F.try_variant_get(v, "$", "string")).otherwise("")


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """All columns with ``reply`` replaced by ``knowledge_answer, general_supplement, insufficient, citations, bad``.

    ``citations`` are structs of ``pos, chunk_id, note_id, quote`` in the reply's order.
    """
    v = F.col("_parsed")
    listed = F.try_variant_get(_field(v, "$.citations"), "$", "array<variant>")

    def citation(item: Column, pos: Column) -> Column:
        quote = _field(item, "$.quote")
        return F.struct(
            pos.alias("pos"),
            text_of(_field(item, "$.chunkId")).alias("chunk_id"),
            text_of(_field(item, "$.noteId")).alias("note_id"),
            F.when(F.schema_of_variant(quote) == "STRING", F.try_variant_get(quote, "$", "string")).otherwise("").alias("quote"),
        )

    # the parser stops behind the first value: inside brackets, whatever follows it is a fault or a second item
    whole = F.try_parse_json(F.concat(F.lit("["), first_json_object(reply), F.lit("]")))
    alone = F.size(F.try_variant_get(whole, "$", "array<variant>")) == 1
    return replies.withColumn("_parsed", F.when(alone, _field(whole, "$[0]"))).select(
        *[c for c in replies.columns if c != reply],
        text_of(_field(v, "$.knowledgeAnswer")).alias("knowledge_answer"),
        text_of(_field(v, "$.generalSupplement")).alias("general_supplement"),
        truth_of(_field(v, "$.insufficient")).alias("insufficient"),
        F.coalesce(let(listed, lambda items: F.transform(items, citation)), F.array().cast(_ITEM)).alias("citations"),
        v.isNull().alias("bad"),
    )


def proposed_citations(parsed: DataFrame) -> DataFrame:
    """``user_id, question_id, pos, chunk_id, note_id, quote`` of all citations."""
    return parsed.select("user_id", "question_id", F.explode("citations").alias("c")).select("user_id", "question_id", "c.*")


def answer_metrics(counts: DataFrame, replies: DataFrame) -> DataFrame:
    """Metric events by fixed categories, never any text: how questions were retrieved for, and how they were answered.

    ``counts``: user_id, question_id, retrieval_mode and candidate counts. ``replies``: user_id, question_id, bad. A question without context, or whose reply
    is missing or bad, falls back to the answer from its context; in basic mode the reply is not parsed.
    """
    sums = [F.sum(c).alias(name) for c, name in (("dense_count", "dense_candidates"), ("keyword_count", "keyword_candidates"), ("context_count", "context"))]
    none = F.lit(None).cast("string")
    retrieved = counts.groupBy(F.lit("knowledge_retrieval").alias("event"), F.lit("success").alias("outcome"), "retrieval_mode", none.alias("failure_category"))
    lost = F.coalesce("bad", F.lit(True)) & (F.col("retrieval_mode") != "basic")
    empty = F.col("context_count") == 0
    answered = counts.join(replies, ["user_id", "question_id"], "left").groupBy(
        F.lit("answer_generation").alias("event"),
        F.when(empty | lost, "fallback").otherwise("model").alias("outcome"),
        "retrieval_mode",
        F.when(~empty & lost, "answer_generation_failed").alias("failure_category"),
    )
    n = F.count(F.lit(1)).alias("n")
    empty_sums = [F.lit(None).cast("long").alias("dense_candidates"), F.lit(None).cast("long").alias("keyword_candidates")]
    last = answered.agg(n, sums[2]).select("event", "outcome", "retrieval_mode", "failure_category", "n", *empty_sums, "context")
    return retrieved.agg(n, *sums).unionByName(last)
