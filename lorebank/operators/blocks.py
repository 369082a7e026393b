"""Splitting hot groups into bounded blocks, and exact top-k cosines block by block.

A user (or any other key) may own a third of all rows, so no group is ever handed to one task whole.
Both sides of a scoring job are cut into blocks of bounded size inside each key; every (left block,
right block) pair is one co-group. A pair is scored in memory with numpy and gives back only its k
best rows per left row, so the full product of a group is never written, shuffled or held. A final
window picks the k best over all blocks, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEFT_BLOCK_ROWS = 16_384
RIGHT_BLOCK_ROWS = 32_768
#: Rows of a key list up to which it is broadcast; a row is a key and a number.
BROADCAST_ROWS = 100_000
#: Left and right rows of a place that are turned into matrices at once, and how many such right pieces are kept in single precision.
_TILE_ROWS = 256
_SLICE_ROWS = 2_048
_SLICES = 4
#: Pairs of a tile, per left row and k, that are worth a look one by one; beyond, the tile is scored whole in double precision.
_CLOSE = 8
#: Lengths of vectors between which single precision neither overflows nor loses digits.
_USUAL = 1e-15, 1e15


def hot_keys(df: DataFrame, keys: list[str], rows_per_block: int, name: str) -> DataFrame:
    """Keys that need more than one block, with their block count.

    At most ``rows / rows_per_block`` keys can qualify, which bounds the table by construction: a
    billion rows in blocks of 4096 give at most 244 141 of these narrow rows.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_block)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_block)).cast("int").alias(name))
    )


def _fresh(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select under new column identities, so that a table can be scored against itself."""
    return df.select(*[F.col(c).alias(c) for c in dict.fromkeys(columns)])


def checked_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table marked for broadcast when it is counted to have ``most`` rows at most; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _with_counts(df: DataFrame, hot: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(hot, keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def assign_block(df: DataFrame, hot: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    """Spread the rows of each key over its blocks by a hash of the row id."""
    counted = _with_counts(df, hot, keys, name)
    return counted.withColumn(name, F.expr(f"pmod(xxhash64({id_col}), {name})").cast("int"))


def copy_to_blocks(df: DataFrame, hot: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One copy of each row per block of the other side."""
    counted = _with_counts(df, hot, keys, name)
    return counted.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(name) - 1)))


def placed(left: DataFrame, right: DataFrame, keys: list[str], left_block: int, right_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block number of their own (``_lb``, ``_rb``), copied to the blocks of the other side. Both have ``keys`` and ``id``.

    Keys without a left row have nothing to score: their right rows stay out. The lists of keys hold narrow rows, those with several blocks at most
    one per block; they are counted first and broadcast only while they are short, so that wide rows do not move for them.
    """
    columns = left.columns, right.columns
    left, right = _fresh(left, columns[0]), _fresh(right, columns[1])
    right = right.join(checked_small(_fresh(left, keys).distinct()), keys, "left_semi")
    hot_left, hot_right = (checked_small(hot_keys(side, keys, size, name)) for side, size, name in ((left, left_block, "_lb"), (right, right_block, "_rb")))
    left = copy_to_blocks(assign_block(left, hot_left, keys, "id", "_lb"), hot_right, keys, "_rb")
    right = copy_to_blocks(assign_block(right, hot_right, keys, "id", "_rb"), hot_left, keys, "_lb")
    return left.select(*columns[0], "_lb", "_rb"), right.select(*columns[1], "_lb", "_rb")


def vector_topk(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    k: int,
    dim: int,
    digits: int,
    left_block: int = LEFT_BLOCK_ROWS,
    right_block: int = RIGHT_BLOCK_ROWS,
) -> DataFrame:
    """The k right rows of highest cosine per left row of their key: ``keys, left_id, right_id, score, rank``; equal ones by ascending right id.

    Both sides have ``keys``, ``id`` and ``vector``. Scores are rounded to ``digits``. A left row whose vector has another width than ``dim`` or a number
    that is not finite has no result; such right rows never are one. Zero right vectors come last.
    """
    out = T.StructType(
        [
            *[left.schema[c] for c in keys],
            T.StructField("left_id", left.schema["id"].dataType),
            T.StructField("right_id", right.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    left, right = (side.select(*keys, "id", _packed("vector", dim).alias("vector")) for side in (left, right))
    left, right = placed(left, right, keys, left_block, right_block)
    place = [*keys, "_lb", "_rb"]
    # Scoring is heavy per byte: a fixed partition count keeps AQE from merging block pairs by size.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *place), right.repartition(tasks, *place)
    scored = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_pair_scorer(keys, k, dim, digits, out), out)
    order = Window.partitionBy(*keys, "left_id").orderBy(F.desc("score"), "right_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pair_scorer(keys: list[str], k: int, dim: int, digits: int, out: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_out = to_arrow_schema(out)

    def score_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow_out.empty_table()
        left, right = (t.filter(pc.is_valid(t.column("vector"))) if t.column("vector").null_count else t for t in (left, right))
        order = pc.sort_indices(right.column("id"))  # column numbers are in the order of equal scores
        tiles = range(0, left.num_rows, _TILE_ROWS)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(tiles)
        for first in range(0, right.num_rows, _SLICE_ROWS * _SLICES):
            pieces = [_right_rows(right.column("vector"), order.slice(at, _SLICE_ROWS), dim, at) for at in range(first, min(first + _SLICE_ROWS * _SLICES, right.num_rows), _SLICE_ROWS)]
            b, nb, number = pieces[0] if len(pieces) == 1 else (np.concatenate(x) for x in zip(*pieces))
            for n, start in enumerate(tiles):
                a, ok = _matrix(left.column("vector").slice(start, _TILE_ROWS), dim)
                r, c, v = best[n]
                found = _tile_best(a, b, nb, k, digits, _kth(r, v, k, len(a)))
                r, c, v = (np.concatenate(x) for x in zip((r, c, v), (found[0], number[found[1]], found[2])))
                by = np.lexsort((c, -v, r))
                r, c, v = r[by], c[by], v[by]
                kept = (np.arange(len(r)) - np.searchsorted(r, r, side="left") < k) & ok[r]
                best[n] = r[kept], c[kept], v[kept]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *((r + start, c, v) for start, (r, c, v) in zip(tiles, best))]
        r, c, v = (np.concatenate(x) for x in zip(*best))
        c = order.to_numpy()[c].astype(np.int64)
        columns = [left.column(key).take(pa.array(r)) for key in [*keys, "id"]]
        columns += [right.column("id").take(pa.array(c)), pa.array(v.astype(np.float64))]
        return pa.table(columns, names=arrow_out.names).cast(arrow_out)

    return score_pair


def _right_rows(vectors: pa.ChunkedArray, at: pa.Array, dim: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The usable vectors of some right rows, in single precision where that loses nothing, their lengths, and their numbers from ``first``."""
    b, ok = _matrix(vectors.take(at), dim)
    b, number = b[ok], first + np.flatnonzero(ok)
    with np.errstate(over="ignore"):
        nb, narrow = np.sqrt(np.einsum("ij,ij->i", b, b)), b.astype(np.float32)
    return (narrow if (narrow == b).all() else b), nb, number


def _kth(r: np.ndarray, v: np.ndarray, k: int, rows: int) -> np.ndarray:
    """The k-th best score so far of each row of a tile, minus infinity without one; ``r`` is in order, ``v`` falls within a row."""
    at = np.searchsorted(r, np.arange(rows), side="left") + k - 1
    held = at < np.searchsorted(r, np.arange(rows), side="right")
    out = np.full(rows, -np.inf)
    out[held] = v[at[held]]
    return out


def _tile_best(a: np.ndarray, b: np.ndarray, nb: np.ndarray, k: int, digits: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row, right row and rounded cosine of at least all pairs that can be among a left row's k best; ``kth`` is the score that it has to reach.

    A product in single precision is off by less than ``slack`` (the standard bound of a dot product of ``dim`` terms, however it is summed). Pairs
    that close to the k-th best are scored again in double precision, so the result is that of a product in double precision.
    """
    with np.errstate(over="ignore"):
        na = np.sqrt(np.einsum("ij,ij->i", a, a))
    usual = all(((n == 0) | ((n > _USUAL[0]) & (n < _USUAL[1]))).all() for n in (na, nb))
    if len(b) and b.dtype == np.float32 and usual:
        unit = (a / np.where(na > 0, na, 1.0)[:, None]).astype(np.float32)
        near = unit @ b.T
        near *= (1.0 / np.where(nb > 0, nb, 1.0)).astype(np.float32)
        near[na == 0] = -2.0
        near[:, nb == 0] = -2.0
        slack = (a.shape[1] + 16) * 2.0**-24 * 1.01 + 10.0**-digits + 1e-7
        least = kth - slack
        new = np.flatnonzero(np.isneginf(kth))
        if len(new) and len(b) > k:
            least[new] = np.partition(near[new], len(b) - k, axis=1)[:, len(b) - k] - 2 * slack
        r, c = np.nonzero(near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
        if len(r) <= _CLOSE * k * len(a):
            v = np.empty(len(r))
            edges = np.searchsorted(r, np.arange(len(a) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                at = slice(edges[i], edges[i + 1])
                v[at] = b[c[at]].astype(np.float64) @ a[i]
            norm = na[r] * nb[c]
            return r, c, np.round(np.where(norm > 0, v / np.where(norm > 0, norm, 1.0), -2.0), digits)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, len(b), _SLICE_ROWS):
        some = b[first : first + _SLICE_ROWS].astype(np.float64)
        scores = np.round(_cosine(a, na, some, nb[first : first + _SLICE_ROWS]), digits)
        r, c = _best(scores, k)
        found.append((r, c + first, scores[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _packed(vector: str, dim: int) -> Column:
    """A list column as bytes, see :func:`_pack`: vectors are copied to places, and numbers of a list travel one by one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, max(len(batch), 1), _TILE_ROWS):
                yield _pack(batch.slice(start, _TILE_ROWS), dim)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(vector)


def _pack(vectors: pa.Array, dim: int) -> pa.Array:
    """One value per vector, null unless it has the exact width and finite numbers. A first byte tells how the numbers follow, without any loss:

    ``c`` how many different single precision numbers less one, these numbers, and one byte per place; ``f`` single precision; ``d`` double precision.
    """
    rows, ok = _matrix(pa.chunked_array([vectors]), dim)
    with np.errstate(over="ignore"):
        narrow = rows.astype(np.float32)
    single = (narrow == rows).all(axis=1)
    out = []
    for i in range(len(rows)):
        if not ok[i]:
            out.append(None)
        elif not single[i]:
            out.append(b"d" + rows[i].tobytes())
        else:
            kinds, code = np.unique(narrow[i], return_inverse=True)
            out.append(b"c" + bytes([len(kinds) - 1]) + kinds.tobytes() + code.astype(np.uint8).tobytes() if 0 < len(kinds) <= 256 else b"f" + narrow[i].tobytes())
    return pa.array(out, pa.binary())


def _unpack(packed: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    out, ok = np.zeros((len(packed), dim)), np.zeros(len(packed), bool)
    for i, value in enumerate(packed):
        raw = value.as_buffer()
        if raw is None:
            continue
        ok[i], kind = True, raw[0:1].to_pybytes()
        if kind == b"c":
            codes = np.frombuffer(raw, np.uint8, dim, raw.size - dim)
            out[i] = np.frombuffer(raw.slice(2, raw.size - dim - 2), np.float32)[codes]
        else:
            out[i] = np.frombuffer(raw.slice(1), np.float32 if kind == b"f" else np.float64)
    return out, ok


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row number per element and the flattened elements of a list column."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)


def _cosine(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    norm = na[:, None] * nb[None, :]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        scores = (a @ b.T) / norm
    # A zero vector has no cosine: such right rows sort behind every real score.
    return np.where(norm > 0, scores, -2.0)


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, or of one that is packed, as a matrix, and which rows have the exact width and finite numbers."""
    if pa.types.is_binary(column.type):
        return _unpack(column, dim)
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    ok = widths == dim
    out = np.zeros((len(column), dim))
    if ok.any():
        kept = column.filter(pa.array(ok))
        out[ok] = _flat(kept)[1].to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok &= np.isfinite(out).all(axis=1)
        out[~ok] = 0.0
    return out, ok


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best entries; columns are already in tie order."""
    m = scores.shape[1]
    if m > k:
        threshold = np.partition(scores, m - k, axis=1)[:, m - k]
        keep = scores >= threshold[:, None]
    else:
        keep = np.ones(scores.shape, bool)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    position = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[position < k], cols[position < k]
