"""Markdown sections and overlapping token windows, computed inside the note's own row.

Nothing here shuffles: headings, breadcrumbs, windows, ordinals and offsets are array expressions over
one row, and a single ``posexplode`` turns the result into chunk rows. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.columns import let
from lorebank.functions.text import col_of, trim_ws
from lorebank.functions.tokens import segments

_ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t\r]*$"
_SETEXT = r"^ {0,3}(?:=+|-+)[ \t\r]*$"
_FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
_CONTAINER = r"^ {0,3}(?:>|[-+*][ \t]|\d{1,9}[.)][ \t]|<[A-Za-z/!?])"
# A body without any of these at a line start is one section.
_STRUCTURE = r"(?m)^ {0,3}(?:#{1,6}(?:[ \t]|$)|=+[ \t\r]*$|-+[ \t\r]*$)"

_BLOCK = "struct<level:int,text:string,start:int,stop:int>"
#: Items that are folded together before they join the rest.
_PIECE = 64
_SECTION = "struct<heading_path:array<string>,start:int,stop:int>"


def _heading_text(raw: Column) -> Column:
    """Heading text without link targets and the commonest inline marks."""
    labels = F.regexp_replace(raw, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return let(F.regexp_replace(labels, r"`|\*\*|__", ""), trim_ws)


def _line_facts(line: Column) -> Column:
    return F.struct(
        F.length(line).alias("len"),
        line.alias("raw"),
        line.rlike(f"^[{K.WS}]*$").alias("blank"),
        F.length(F.regexp_extract(line, _ATX, 1)).alias("level"),
        F.regexp_extract(line, _ATX, 2).alias("heading"),
        line.rlike(_SETEXT).alias("underline"),
        F.regexp_extract(line, _FENCE, 1).alias("fence"),
        line.rlike(r"^ {0,3}(?:`{3,}|~{3,})[ \t\r]*$").alias("fence_only"),
        line.rlike(_CONTAINER).alias("container"),
        line.rlike(r"^ ").alias("indented"),
    )


def _step(a: Column, x: Column) -> Column:
    """One line: update the open block (kind 0 none, 1 paragraph, 2 container, 3 fence)."""
    inside = a["fence"] != ""
    closes = inside & x["fence_only"] & F.startswith(trim_ws(x["raw"]), a["fence"])
    event = (
        F.when(closes, "close")
        .when(inside, "fence")
        .when(x["blank"], "blank")
        .when((x["level"] > 0) & ~((a["kind"] == 2) & x["indented"]), "heading")
        .when(x["underline"] & (a["kind"] == 1), "underline")
        .when(x["fence"] != "", "open")
        .when(x["container"] & (a["kind"] != 2), "container")
        .otherwise("text")
    )

    def update(e: Column) -> Column:
        starts = e.isin("open", "container") | ((e == "text") & (a["kind"] == 0))
        end = a["pos"] + x["len"]
        level = F.when(e == "heading", x["level"]).otherwise(F.when(x["raw"].rlike("^ *="), 1).otherwise(2))
        text = _heading_text(F.when(e == "heading", x["heading"]).otherwise(a["text"]))
        head = F.array(F.struct(level.alias("level"), text.alias("text"), a["pos"].alias("start"), end.alias("stop")))
        stop = F.when(e == "close", end).otherwise(a["stop"])
        flushed = F.when(
            a["kind"] > 0,
            F.concat(
                a["blocks"],
                F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"), a["start"].alias("start"), stop.alias("stop"))),
            ),
        ).otherwise(a["blocks"])
        return F.struct(
            (end + 1).alias("pos"),
            F.when(e == "open", x["fence"]).when(e == "close", "").otherwise(a["fence"]).alias("fence"),
            F.when(e.isin("blank", "heading", "underline", "close"), 0)
            .when(e.isin("open", "fence"), 3)
            .when(e == "container", 2)
            .when(a["kind"] == 0, 1)
            .otherwise(a["kind"])
            .alias("kind"),
            F.when(starts, a["pos"]).otherwise(a["start"]).alias("start"),
            F.when(e.isin("open", "fence", "container", "text"), end).otherwise(a["stop"]).alias("stop"),
            F.when((e == "text") & (a["kind"] == 0), x["raw"])
            .when((e == "text") & (a["kind"] == 1), F.concat(a["text"], F.lit("\n"), x["raw"]))
            .otherwise("")
            .alias("text"),
            F.when(e == "heading", F.concat(flushed, head))
            .when(e == "underline", F.concat(a["blocks"], head))
            .when(e.isin("blank", "open", "container", "close"), flushed)
            .otherwise(a["blocks"])
            .alias("blocks"),
        )

    return let(event, update)


def _pieces(items: Column) -> Column:
    """An array cut into arrays of ``_PIECE`` items."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_PIECE)), lambda i: i < F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i + 1, _PIECE))


def _fold(items: Column, state: Column, step: Callable[[Column, Column], Column], grown: str, finish: Callable[[Column], Column]) -> Column:
    """``aggregate`` whose accumulator has a growing array.

    An accumulator is copied at every step. Here a piece of the items collects into an array of its own, which is
    appended once, so the copies cost items * _PIECE + items^2 / _PIECE instead of items^2.
    """

    def of_pieces(pieces: Column) -> Column:
        def piece_step(a: Column, piece: Column) -> Column:
            empty = F.filter(a[grown], lambda _: F.lit(False))
            return let(
                F.aggregate(piece, a.withField(grown, empty), step),
                lambda r: r.withField(grown, F.concat(a[grown], r[grown])),
            )

        return F.aggregate(pieces, state, piece_step, finish)

    return let(items, lambda bound: let(_pieces(bound), of_pieces))


def _blocks(content: Column) -> Column:
    """Top-level headings (level > 0) and other blocks (level 0) of a body, in order."""
    state = F.struct(
        F.lit(0).alias("pos"),
        F.lit("").alias("fence"),
        F.lit(0).alias("kind"),
        F.lit(0).alias("start"),
        F.lit(0).alias("stop"),
        F.lit("").alias("text"),
        F.array().cast(f"array<{_BLOCK}>").alias("blocks"),
    )
    # A blank line appended at the end closes whatever block is still open, except an open fence.
    lines = F.transform(F.split(F.concat(content, F.lit("\n")), "\n"), _line_facts)

    def finish(a: Column) -> Column:
        tail = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"), a["start"].alias("start"), a["stop"].alias("stop")))
        return F.when(a["kind"] > 0, F.concat(a["blocks"], tail)).otherwise(a["blocks"])

    return _fold(lines, state, _step, "blocks", finish)


def _fold_blocks(blocks: Column) -> Column:
    """Breadcrumb stack over the blocks; neighbours with an equal breadcrumb share a section."""
    none = F.lit(None).cast(_SECTION)
    state = F.struct(
        F.array().cast("array<struct<level:int,text:string>>").alias("stack"),
        none.alias("open"),
        F.array().cast(f"array<{_SECTION}>").alias("sections"),
    )

    def closed(a: Column) -> Column:
        return F.when(a["open"].isNotNull(), F.concat(a["sections"], F.array(a["open"]))).otherwise(a["sections"])

    def step(a: Column, b: Column) -> Column:
        kept = F.filter(a["stack"], lambda s: s["level"] < b["level"])
        stack = F.when(
            b["level"] > 0,
            F.concat(kept, F.array(F.struct(b["level"].alias("level"), b["text"].alias("text")))),
        ).otherwise(a["stack"])
        path = F.transform(a["stack"], lambda s: s["text"])
        same = F.coalesce(a["open"]["heading_path"] == path, F.lit(False))
        start = F.when(same, a["open"]["start"]).otherwise(b["start"])
        now = F.struct(path.alias("heading_path"), start.alias("start"), b["stop"].alias("stop"))
        return F.struct(
            stack.alias("stack"),
            F.when(b["level"] > 0, a["open"]).otherwise(now).alias("open"),
            F.when((b["level"] > 0) | same, a["sections"]).otherwise(closed(a)).alias("sections"),
        )

    return _fold(blocks, state, step, "sections", closed)


def sections(content: Column | str) -> Column:
    """``array<struct<heading_path, start, text>>``: trimmed section texts with their offsets."""
    body = F.coalesce(col_of(content), F.lit(""))

    def cut(path: Column, start: Column, raw: Column) -> Column:
        lead = F.length(F.regexp_extract(raw, f"^[{K.WS}]*", 0))
        return F.struct(path.alias("heading_path"), (start + lead).alias("start"), trim_ws(raw).alias("text"))

    whole = F.array(cut(F.array().cast("array<string>"), F.lit(0), body))

    def cut_piece(piece: Column) -> Column:
        # one substring of the body per piece of sections, since each walks the text from its beginning
        first = F.element_at(piece, 1)["start"]
        part = F.substring(body, first + 1, F.element_at(piece, -1)["stop"] - first)
        return let(part, lambda t: F.transform(piece, lambda s: cut(s["heading_path"], s["start"], F.substring(t, s["start"] - first + 1, s["stop"] - s["start"]))))

    split = let(_fold_blocks(_blocks(body)), lambda found: F.flatten(F.transform(_pieces(found), cut_piece)))
    parts = F.when(body.rlike(_STRUCTURE), split).otherwise(whole)
    return F.filter(parts, lambda s: s["text"] != "")


def _joined(toks: Column) -> Column:
    """Window text; only its last token can end in blanks."""
    blanks = F.length(F.regexp_extract(F.element_at(toks, -1), f"[{K.WS}]*$", 0))
    return let(F.array_join(toks, ""), lambda text: F.left(text, F.length(text) - blanks))


def _windows(section: Column, size: int, overlap: int) -> Column:
    step = size - overlap

    def of_segments(segs: Column) -> Column:
        n = F.size(segs)
        count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)

        def of_lengths(lens: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda w: let(
                    F.struct(
                        F.slice(segs, w * step + 1, size).alias("toks"),
                        (section["start"] + F.aggregate(F.slice(lens, 1, w), F.lit(0), lambda a, v: a + v)).alias("start"),
                    ),
                    lambda p: let(
                        _joined(p["toks"]),
                        lambda text: F.struct(
                            section["heading_path"].alias("heading_path"),
                            text.alias("content"),
                            p["start"].alias("start_offset"),
                            (p["start"] + F.length(text)).alias("end_offset"),
                            F.size(p["toks"]).alias("token_count"),
                        ),
                    ),
                ),
            )

        # Window starts are a fixed step apart, so one pass over the text gives every start offset.
        lens = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda j: F.length(F.array_join(F.slice(segs, j * step + 1, step), "")),
        )
        return let(lens, of_lengths)

    return let(segments(section["text"]), of_segments)


def window_shape(target: int, maximum: int, overlap: int) -> tuple[int, int]:
    """Effective window size and overlap."""
    size = max(1, min(target, maximum))
    return size, max(0, min(overlap, size - 1))


def chunks_of(
    content: Column | str,
    target: int = K.CHUNK_TARGET,
    maximum: int = K.CHUNK_MAX,
    overlap: int = K.CHUNK_OVERLAP,
) -> Column:
    """All chunks of a body as an array, in document order; blank bodies give an empty array."""
    size, lap = window_shape(target, maximum, overlap)
    return F.flatten(F.transform(sections(content), lambda s: _windows(s, size, lap)))


def chunk_notes(
    notes: DataFrame,
    target: int = K.CHUNK_TARGET,
    maximum: int = K.CHUNK_MAX,
    overlap: int = K.CHUNK_OVERLAP,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Chunk rows of ``notes(user_id, note_id, content)``; ordinals number a note's chunks from 0."""
    return notes.select(
        "user_id",
        "note_id",
        *carry,
        F.posexplode(chunks_of("content", target, maximum, overlap)).alias("ordinal", "c"),
    ).select(
        # six digits at least; lpad would cut longer ordinals
        F.concat_ws("#", F.col("note_id"), F.lpad(F.col("ordinal").cast("string"), F.greatest(F.length(F.col("ordinal").cast("string")), F.lit(6)), F.lit("0"))).alias("chunk_id"),
        "user_id",
        "note_id",
        *carry,
        "ordinal",
        "c.*",
    )


def section_rows(notes: DataFrame) -> DataFrame:
    return notes.select("user_id", "note_id", F.posexplode(sections("content")).alias("section", "s")).select(
        "user_id", "note_id", "section", "s.*"
    )
