"""Temporary views for SQL users of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebank.operators import facets as FA
from lorebank.operators import index as I


def register_views(spark: SparkSession, notes: DataFrame, ledger: DataFrame, chunks: DataFrame) -> list[str]:
    """Create the views ``note_chunks, searchable_chunks, postings, index_coverage, index_states, tag_facets,
    relation_edges`` over a library; they stay lazy, so filters on them reach the tables underneath."""
    views = {
        "note_chunks": I.index_rows(notes),
        "searchable_chunks": I.searchable(chunks, ledger, notes, ("title", "source", "topic", "tags")),
        "postings": I.postings(chunks),
        "index_coverage": I.coverage(notes, ledger, chunks),
        "index_states": I.index_states(notes, ledger, chunks),
        "tag_facets": FA.tag_facets(notes),
        "relation_edges": FA.relation_edges(notes),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
