"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A vector's code is the sign pattern of ``BITS`` rotated coordinates; the rotations are fitted by iterative
quantisation on at most ``SAMPLE`` vectors, those with the smallest hash of their id. Codes are cut into substrings of one byte, each indexed
by value. If two codes differ in at most r bits, then by the pigeonhole principle some substring differs in at most
r // m bits (in fewer for all but the first r % m + 1), so probing the values that near retrieves every code
within r. What is retrieved is checked by its full Hamming distance and ranked by the exact distance of the original vectors.

The radius is learned on the sample too: the ``REACH`` quantile of the Hamming distances of true neighbours there. Neighbours in
the whole table are nearer than in a sample, so recall does not fall with size. A query that finds too few codes in a block widens its
radius until it has enough or all. Index rows and queries are dealt in blocks of bounded size, each pair of blocks is one
task's work, and every pair returns at most k rows per query.

Equal vectors are one index entry with its k + 1 smallest ids (no query can return more of them), so a vector that a third of all rows share
costs as much as any other.

Defined cases: rows with null ids and null, empty, zero or non-finite vectors take no part; vectors are compared within equal length
only; repeated rows count once; ties go to the smaller id; an id with several vectors is one candidate per vector and, as a query,
asks once for each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebank.llm.common import stored

BITS = 256
SAMPLE = 8192
REACH = 0.985
ROUNDS = 15
#: Rows of an index block and of a query block.
BLOCK = 32_768
ASKED = 4_096
BYTES = BITS // 8


# -- codes -------------------------------------------------------------------------------------


@dataclass
class Model:
    center: np.ndarray
    rotation: np.ndarray  # dimension x BITS
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.center) @ self.rotation > 0, axis=1)


def _quantise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal rotation under which signs lose least, alternating signs and the Procrustes solution."""
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(ROUNDS if len(x) else 0):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ vt
    return r


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to one code ``b``."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def fit(x: np.ndarray, dim: int, k: int) -> Model:
    """Rotations enough for ``BITS`` signs, and the radius, from sampled vectors (possibly none)."""
    rng = np.random.default_rng(10)
    center = x.mean(axis=0) if len(x) else np.zeros(dim)
    base = np.eye(dim)
    if dim > BITS:  # the leading principal directions
        _, _, vt = np.linalg.svd(x - center if len(x) else np.zeros((1, dim)), full_matrices=True)
        base = vt[:BITS].T
    turned = (x - center) @ base
    rotation = np.concatenate([base @ _quantise(turned, rng) for _ in range(-(-BITS // base.shape[1]))], axis=1)[:, :BITS]
    m = Model(center, rotation, BITS)
    if len(x) > k + 1:
        codes, far = m.codes(x), []
        for i in range(0, len(x), max(1, len(x) // 512)):
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argpartition(d, k)[:k]
            far.append(hamming(codes[near], codes[i]))
        m.radius = int(np.quantile(np.concatenate(far), REACH, method="higher"))
    return m


@lru_cache(maxsize=None)
def probe_masks(radius: int) -> np.ndarray:
    """Byte values with at most ``radius`` bits set; none for a negative radius."""
    every = np.arange(256)
    return every[np.bitwise_count(every.astype(np.uint8)) <= radius]


class Tables:
    """One table per substring over the codes of a block: rows in order of the substring's value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(BYTES)]
        self.begin = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within ``radius``."""
        low, extra = divmod(radius, BYTES)
        seen = np.zeros(len(self.codes), bool)
        for s in range(BYTES):
            order, begin = self.order[s], self.begin[s]
            for v in (probe_masks(low if s <= extra else low - 1) ^ code[s]).tolist():
                seen[order[begin[v] : begin[v + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]


def search_block(x: np.ndarray, ids: list[list[int]], tables: Tables, model: Model, own: int, q: np.ndarray, code: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest (id, distance) that the block holds within the radius for one query."""
    radius = model.radius
    while True:
        rows = tables.within(code, radius)
        if len(rows) > k or radius >= BITS:
            break
        radius = min(BITS, radius + BYTES)
    d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
    edge = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
    found = sorted((dist, i) for r, dist in zip(rows[d <= edge].tolist(), d[d <= edge].tolist()) for i in ids[r] if i != own)
    return [(i, dist) for dist, i in found[:k]]


# -- tables ------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Finite, not null, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """``vec, ids``: distinct vectors with their k + 1 smallest ids; the limit acts before the shuffle too."""
    nth = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` picks."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    index = stored(points(rows, k).withColumns({"dim": F.size("vec"), "row": F.monotonically_increasing_id()}), "ann-points")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked = stored(asked.withColumns({"dim": F.size("vec"), "query": F.monotonically_increasing_id()}), "ann-queries")

    picked = index.select("vec", "dim", F.element_at("ids", 1).alias("first")).orderBy(F.xxhash64("first"), "first", F.xxhash64("vec")).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    models = {d: fit(np.array(x), d, k) for d, x in by_dim.items()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            dim = left["dim"][0].as_py()
            model = models.get(dim) or fit(np.zeros((0, dim)), dim, k)
            x, qs = (np.array(t["vec"].combine_chunks().flatten()).reshape(-1, dim) for t in (left, right))
            tables, ids = Tables(model.codes(x)), left["ids"].to_pylist()
            for q, code, own, key in zip(qs, model.codes(qs), right["query_id"].to_pylist(), right["query"].to_pylist()):
                out += [(key, own, i, d) for i, d in search_block(x, ids, tables, model, own, q, code, k)]
        kinds = {"query": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array([r[j] for r in out], kind) for j, (n, kind) in enumerate(kinds.items())})

    index_blocks, query_blocks = max(1, -(-index.count() // BLOCK)), max(1, -(-asked.count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("ib", F.pmod(F.xxhash64("row"), F.lit(index_blocks)).cast("int")).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("ib", every(index_blocks))
    keys = ["dim", "ib", "qb"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
