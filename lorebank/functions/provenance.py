"""Provenance: the block written into imported notes, its reliability class, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.text import col_of, or_default, trim_ws


def _line(content: Column | str, prefix: str, value: str = r"[^\n\r]+") -> Column:
    return trim_ws(F.regexp_extract(col_of(content), rf"(?m)^{prefix}({value})$", 1))


def reliability(url: Column, method: Column, source_type: Column) -> Column:
    """Reliability class, first match wins."""
    return (
        F.when(F.contains(method, F.lit(K.METHOD_AUTO_CAPTION)), K.REL_AUTO_CAPTION)
        .when(F.contains(method, F.lit(K.METHOD_TRANSCRIPT)), K.REL_TRANSCRIPT)
        .when(
            F.contains(method, F.lit(K.METHOD_UPLOAD)),
            F.when(source_type == "image", K.REL_UPLOAD_IMAGE).otherwise(K.REL_UPLOAD_FILE),
        )
        .when(F.contains(method, F.lit(K.METHOD_OCR)), K.REL_OCR)
        .when(url.rlike(K.HTTP_URL), K.REL_LINK)
        .when(url == K.REL_PASTED, K.REL_PASTED)
        .otherwise(K.REL_CARD)
    )


def trace_block(platform: Column, url: Column, method: Column, source_type: Column, at: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit(K.TRACE_HEADING),
        F.lit(""),
        F.concat(F.lit(K.TRACE_PLATFORM), or_default(platform, K.EXTERNAL_PLATFORM)),
        F.concat(F.lit(K.TRACE_ORIGIN), or_default(url, K.UNKNOWN_SOURCE)),
        F.concat(F.lit(K.TRACE_METHOD), method),
        F.concat(F.lit(K.TRACE_RELIABILITY), reliability(F.coalesce(url, F.lit("")), method, source_type)),
        F.concat(F.lit(K.TRACE_TIME), at),
    )


def source_markdown(
    title: Column, body: Column, platform: Column, url: Column, method: Column, source_type: Column, at: Column
) -> Column:
    """Note body of an import: title, provenance block, text."""
    return F.concat(
        F.lit("# "), title, F.lit("\n\n"), trace_block(platform, url, method, source_type, at), F.lit("\n\n"), trim_ws(body), F.lit("\n")
    )


def pending_markdown(
    title: Column, platform: Column, url: Column, source_type: Column, reason: Column, description: Column, at: Column
) -> Column:
    """Card body for a source whose text could not be read."""
    body = F.concat_ws(
        "\n",
        F.lit(K.PENDING_HEADING),
        F.lit(""),
        F.concat(F.lit("> "), reason),
        F.lit(""),
        description,
        F.lit(""),
        *[F.lit(line) for line in K.PENDING_LINES],
    )
    return source_markdown(title, body, platform, url, F.lit(K.PENDING_METHOD), source_type, at)


def note_source(content: Column | str, source: Column | str) -> Column:
    """Origin named in the body, else the source field, else empty."""
    return F.coalesce(
        F.nullif(_line(content, K.TRACE_ORIGIN), F.lit("")),
        F.nullif(_line(content, K.TRACE_ORIGIN_LINK), F.lit("")),
        F.nullif(_line(content, K.TRACE_PLAIN), F.lit("")),
        col_of(source),
        F.lit(""),
    )


def parse_trace(content: Column | str, source: Column | str) -> Column:
    """``struct<platform, import_method, reliability, source_url>`` of a note, with fallbacks."""
    body, src = col_of(content), F.coalesce(col_of(source), F.lit(""))
    linked = body.rlike(rf"(?m)^{K.TRACE_ORIGIN}https?://") | body.rlike(rf"(?m)^{K.TRACE_PLAIN}https?://")
    by_source = F.when(linked, K.REL_LINK).when(src != "", src).otherwise(K.MANUAL_METHOD)
    url = trim_ws(F.regexp_extract(body, rf"(?m)^{K.TRACE_ORIGIN}(https?://[^{K.WS}]+)$", 1))
    return F.struct(
        or_default(_line(body, K.TRACE_PLATFORM), or_default(src, K.UNKNOWN_SOURCE)).alias("platform"),
        or_default(_line(body, K.TRACE_METHOD), K.MANUAL_METHOD).alias("import_method"),
        or_default(_line(body, K.TRACE_RELIABILITY), by_source).alias("reliability"),
        or_default(url, F.when(src.rlike(K.HTTP_URL), src).otherwise("")).alias("source_url"),
    )
