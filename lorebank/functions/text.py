"""String expressions over note bodies: titles, summaries, plain text, quotes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebank import constants as K


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of ``K.WS`` themselves.
_BLANKS = "".join(chr(i) for i in range(0x10000) if re.fullmatch(f"[{re.sub(r'x{(.{2,4})}', lambda m: f'u{int(m[1], 16):04x}', K.WS)}]", chr(i)))


def trim_ws(c: Column | str) -> Column:
    """Strip every ECMAScript whitespace character at both ends (``F.trim`` strips blanks only).

    Texts are long and their ends short, so characters are compared from both ends. In front of a last U+0085, which ends a line in Java's
    patterns but is not in the set, the pattern strips too.
    """
    text = col_of(c)
    return F.when(F.endswith(text, F.lit("\x85")), F.regexp_replace(text, f"^[{K.WS}]+|[{K.WS}]+$", "")).otherwise(F.btrim(text, F.lit(_BLANKS)))


def squash_ws(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), f"[{K.WS}]+", " ")


def is_blank(c: Column | str) -> Column:
    return col_of(c).rlike(f"^[{K.WS}]*$")


def or_default(c: Column | str, default: Column | str) -> Column:
    """The value unless it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(col_of(c), F.lit("")), fallback)


def first_filled_line(c: Column | str) -> Column:
    """First line with a non-blank character, trimmed; empty when there is none."""
    return trim_ws(F.regexp_extract(col_of(c), rf"[^{K.WS}][^\n]*", 0))


def _heading(c: Column) -> Column:
    # most bodies have no mark at all
    return F.when(F.contains(c, F.lit("#")), F.regexp_extract(c, rf"(?m)^#[{K.WS}]+([^\n\r]+)$", 1)).otherwise("")


def title_from_body(c: Column | str, placeholder: str = K.UNTITLED_MARKDOWN) -> Column:
    """First level-1 heading, else the first filled line cut to 48, else the placeholder."""
    body = col_of(c)
    heading = _heading(body)
    line = F.left(first_filled_line(body), F.lit(K.TITLE_PREVIEW))
    return F.when(heading != "", trim_ws(heading)).otherwise(or_default(line, placeholder))


def title_with_fallback(c: Column | str, given: Column | str) -> Column:
    """First level-1 heading, else the given title, else the placeholder."""
    return or_default(trim_ws(_heading(col_of(c))), or_default(given, K.UNTITLED_NOTE))


def drop_heading_marks(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), rf"(?m)^#+[{K.WS}]+", "")


def summary_of(c: Column | str) -> Column:
    """The first characters of a body without heading marks, whitespace collapsed.

    The beginning of the body decides when enough is left of it: only its last mark or blanks could still grow with what follows.
    """
    body, start = col_of(c), F.left(col_of(c), F.lit(4 * K.SUMMARY_PREVIEW))
    settled = F.regexp_replace(squash_ws(drop_heading_marks(start)), r"^ |#* ?\z", "")
    whole = F.left(trim_ws(squash_ws(drop_heading_marks(body))), F.lit(K.SUMMARY_PREVIEW))
    return F.when(F.length(settled) > K.SUMMARY_PREVIEW, F.left(settled, F.lit(K.SUMMARY_PREVIEW))).otherwise(whole)


def plain_text(c: Column | str) -> Column:
    """Body without fenced code and Markdown marks, whitespace collapsed."""
    no_code = F.regexp_replace(col_of(c), r"(?s)```.*?```", "")
    return trim_ws(squash_ws(F.regexp_replace(no_code, r"[#>*_\-\[\]()`]", "")))


def first_line(c: Column | str) -> Column:
    return F.left(first_filled_line(drop_heading_marks(c)), F.lit(K.TITLE_PREVIEW))


def default_quote(c: Column | str) -> Column:
    """Body without its leading title line, first 220 characters."""
    body = col_of(c)
    rest = trim_ws(F.regexp_replace(body, rf"^#[{K.WS}]+[^\n\r]+\r?\n+", ""))
    return F.left(or_default(rest, trim_ws(body)), F.lit(K.NOTE_QUOTE_LIMIT))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col_of(c), 256)


def file_name_of(title: Column | str) -> Column:
    """Title usable as a file name: reserved characters replaced, cut to 60, never empty."""
    return or_default(F.left(F.regexp_replace(col_of(title), r'[\\/:*?"<>|]', "-"), F.lit(60)), "note")


def redact_log(c: Column | str) -> Column:
    """Database urls and bearer tokens removed from log text."""
    no_url = F.regexp_replace(col_of(c), rf"(?i)postgres(?:ql)?://[^{K.WS}]+", "[database-url-redacted]")
    return F.regexp_replace(no_url, rf"(?i)Bearer[{K.WS}]+[A-Za-z0-9._~-]+", "Bearer [redacted]")


def first_json_object(c: Column | str) -> Column:
    """The outermost ``{…}`` of a model reply, or the text itself."""
    text = trim_ws(c)
    return or_default(F.regexp_extract(text, r"(?s)\{.*\}", 0), text)
