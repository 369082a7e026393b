"""Finding quotes in a library without comparing every quote with every note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.functions.columns import let
from lorebank.operators.answers import locate_quote

_WORD = r"[\p{L}\p{N}]+"
_GRAM = 4
_CHARS = 3
#: Cells that anchors mark.
_CELLS = 1 << 20


def _words(c: str) -> Column:
    return F.regexp_extract_all(F.col(c), F.lit(_WORD), F.lit(0))


def _grams(words: Column, n: int) -> Column:
    """Every run of n words, in order; empty for shorter texts."""

    def runs(ws: Column) -> Column:
        last = F.size(ws) - n
        all_runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))
        return F.when(last >= 0, all_runs).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def _char_runs(c: str) -> Column:
    """Every run of one to three characters."""

    def runs(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1)))

        def of_length(n: int) -> Column:
            return F.transform(at, lambda i: F.array_join(F.slice(chars, i, n), ""))

        return F.flatten(F.array(*[of_length(n) for n in range(1, _CHARS + 1)]))

    return let(F.split(F.col(c), ""), runs)


def _anchor(quote: DataFrame) -> DataFrame:
    """Quotes with their ``kind`` (r: a run of inner words, w: one inner word, c: first characters) and ``anchor``."""
    w = _words("quote")
    asked = quote.withColumn("inner", F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))
    # the longest is the least likely to be frequent
    longest = lambda items: F.array_max(F.transform(items, lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"]
    kind = F.when(F.size("inner") >= _GRAM, "r").when(F.size("inner") > 0, "w").otherwise("c")
    anchor = F.when(F.size("inner") >= _GRAM, longest(_grams(F.col("inner"), _GRAM))).when(F.size("inner") > 0, longest(F.col("inner"))).otherwise(F.left("quote", F.lit(_CHARS)))
    return asked.withColumns({"kind": kind, "anchor": anchor}).where(F.col("anchor") != "").drop("inner")


def _marks(anchored: DataFrame) -> bytearray:
    """One byte per cell, set where an anchor falls; comes packed from Spark, ``_CELLS / 64`` numbers at most, however many quotes there are."""
    cell = F.xxhash64("kind", "anchor").bitwiseAND(_CELLS - 1)
    bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    rows = anchored.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    marks = bytearray(_CELLS)
    for r in rows:
        for i in range(64):
            if r.bits >> i & 1:
                marks[64 * r.word + i] = 1
    return marks


def find_quotes(notes: DataFrame, quotes: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """All (quote, note) pairs with the first place where the quote stands verbatim.

    ``within`` names columns of both sides that must agree, such as ``user_id``: a quote is then looked for in its own
    user's notes only.

    ``notes``: note_id, content; ``quotes``: quote_id, quote. A verbatim quote shares all of its inner
    words with the note (its first and last word may be cut), so one run of four inner words is a
    sound join key; quotes with fewer inner words use one inner word, and quotes of at most two words
    use their first three characters. Texts are scanned once: of all their runs only those whose cell is marked by an
    anchor leave the row, in one explode; kinds that no quote has are not built. Candidates are verified on the text, so marks and anchor only prune.
    """
    anchored = _anchor(quotes)
    kinds = sorted(r.kind for r in anchored.select("kind").distinct().collect())
    keys = {"r": lambda: _grams(_words("content"), _GRAM), "w": lambda: _words("content"), "c": lambda: _char_runs("content")}
    marks, one = F.lit(_marks(anchored)), F.lit(bytearray(b"\x01"))

    def marked(kind: str) -> Column:
        """The marked runs of one kind in a text, as structs of kind and anchor."""

        def hit(anchor: Column) -> Column:
            cell = F.xxhash64(F.lit(kind), anchor).bitwiseAND(_CELLS - 1)
            return F.substr(marks, (cell + 1).cast("int"), F.lit(1)) == one

        return F.transform(F.filter(F.array_distinct(keys[kind]()), hit), lambda anchor: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor")))

    found = [marked(kind) for kind in kinds]
    none = F.array().cast("array<struct<kind:string,anchor:string>>")
    found = notes.select(*within, "note_id", F.explode(F.flatten(F.array(none, *found))).alias("a")).select(*within, "note_id", "a.*")
    pairs = found.join(anchored.select(*within, "quote_id", "quote", "kind", "anchor"), [*within, "kind", "anchor"]).select(*within, "note_id", "quote_id", "quote")
    return (
        pairs.join(notes.select(*within, "note_id", "content"), [*within, "note_id"])
        .where(F.contains("content", "quote"))
        .withColumn("at", locate_quote("content", "quote"))
        .select(*within, "quote_id", "note_id", "at.start", "at.stop")
    )
