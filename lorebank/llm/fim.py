"""Fill-in-the-middle rewriting of whole documents, cut between tokens by rank on a compressed boundary set.

A text is cut into tokens ``[A-Za-z]+|[^A-Za-z]`` over code points. The places where tokens begin, and the end of the text, are kept in a
:class:`BoundarySet`: 65 536 places share a container, which is a sorted array, a bitmap or a list of runs, whichever is smallest, with
cumulative cardinalities over the containers. A cut "after k tokens" is the k-th member: a binary search over the cumulative
cardinalities finds the container, a select inside it finds the place. Two draws give two ranks, hence both cuts.

Draws are digest parts of the seed and the id alone: reruns, partitioning and lost executors do not matter. Everything is local to a row.

Defined cases: null and empty texts have no tokens and stay plain; a text with one of the three marks stays plain; a null id draws as the text
``null``; repeated rows are rewritten alike, each; whole texts of any length are handled, one at a time; an empty table gives no rows.
Other columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Characters of output that are handed over at once.
FLUSH = 8 << 20

_SPAN = 1 << 16
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


class ArrayContainer:
    """Sorted low halves of the places."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per place; a select counts bits of 64-bit words, then bits inside one word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(_SPAN, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(upto, k, "right"))
        left = k - (int(upto[word - 1]) if word else 0)
        inside = np.flatnonzero(np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(inside[left])


class RunContainer:
    """First place and length of every run of neighbouring places."""

    def __init__(self, low: np.ndarray, begins: np.ndarray) -> None:
        self.first = low[begins].astype(np.uint16)
        self.length = np.diff(np.append(begins, len(low)))

    def select(self, k: int) -> int:
        upto = np.cumsum(self.length)
        run = int(np.searchsorted(upto, k, "right"))
        return int(self.first[run]) + k - (int(upto[run - 1]) if run else 0)


class BoundarySet:
    """A compressed sorted set of places with select by rank."""

    def __init__(self, places: np.ndarray) -> None:
        high = places >> 16
        cut = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[cut]
        self.upto = np.append(cut[1:], len(places))
        self.containers = [_container(part & (_SPAN - 1)) for part in np.split(places, cut[1:])] if len(places) else []

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.high[at]) << 16) + self.containers[at].select(k - before)


def _container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    as_array, as_bitmap, as_runs = 2 * len(low), _SPAN // 8, 4 * len(begins)
    if as_runs < min(as_array, as_bitmap):
        return RunContainer(low, begins)
    return ArrayContainer(low) if as_array <= as_bitmap else BitmapContainer(low)


def boundaries(text: str) -> BoundarySet:
    """Begin of every token and the end of the text; the empty text has its end alone."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = points | np.uint32(0x20)
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    inside = np.zeros(len(points) + 1, bool)
    inside[1:-1] = letter[1:] & letter[:-1]
    return BoundarySet(np.flatnonzero(~inside))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id."""
    digest = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rewrite(doc_id: int | None, text: str, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    places = boundaries(text)
    n = len(places) - 1
    one, two, three, four = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((places.select(one % (n + 1)), places.select(two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row: tokens, form, lengths in code points and the text to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ident = doc.as_py()
                rows.append((ident, *rewrite(ident, text.as_py() or "", seed, plain_percent, spm_percent)))
                held += len(rows[-1][-1])
                if held >= FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)]
    arrays[-1] = arrays[-1].cast(pa.string()) if arrays[-1].nbytes < 2**31 else arrays[-1]
    return pa.RecordBatch.from_arrays(arrays, _ARROW.names)


def restore(output: Column, form: Column) -> Column:
    """The text that was rewritten. No mark can arise where a part meets a mark, so each mark is found once."""
    front, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def two(mark: str) -> tuple[Column, Column]:
        head = F.substring_index(front, mark, 1)
        return F.substr(head, F.lit(4)), F.substring_index(front, mark, -1)

    psm, spm = two(SUFFIX), two(PREFIX)
    return F.when(form == "psm", F.concat(psm[0], middle, psm[1])).when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(output)
