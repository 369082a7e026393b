"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: one coordinate per hashed word (weight log(1 + count), scaled to length one) and
one per structure statistic or metadata value, cut into bins. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

all pairwise interactions at rank ``RANK`` in time linear in the coordinates. It is trained by AdaGrad on at most
``SAMPLE`` labelled documents, those with the smallest hash of their id; the parameters (``DIMS`` x (1 + RANK) numbers) go to
every task that scores. Structure: length, mean word and line length, shares of symbols, digits, capitals, words that end in a
symbol, separators, distinct words, words said twice in a row. Metadata: the stated n_chars against the real length. Labels, lang, source and
doc_id are no inputs.

Defined cases: null and empty texts have no words and are scored by their structure; rows with a null label or null id
teach nothing; conflicting labels of an id all count; without any label every score is 0.5; missing n_chars is a bin of its own;
repeated rows are scored each and teach each; very long texts are read whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import stored
from lorebank.llm.words import SLICE, _SPACE, byte_counts, find_words, hash_words, text_slices

#: Coordinates for words; the bins of the statistics follow.
WORDS = 1 << 15
BINS = 16
STATS = 12
DIMS = WORDS + STATS * BINS
RANK = 8
#: The bounded sample that the model is fitted on.
SAMPLE = 20_000
#: Passes over the sample, and the fewest steps that a small sample gets.
EPOCHS = 6
STEPS = 1500
BATCH = 64
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True

FEATURES = pa.schema([("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])


def _bin(x: np.ndarray, top: float) -> np.ndarray:
    """Shares and ratios to bins: finer near zero."""
    return np.minimum(BINS - 1, np.sqrt(np.clip(x / top, 0, 1)) * BINS).astype(np.int64)


def _sparse(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, values and first coordinate of each document of a piece."""
    docs = len(offs) - 1
    starts, ends, first = find_words(data, offs)
    words = np.diff(first)
    owner = np.repeat(np.arange(docs), words)
    hashes = hash_words(data, starts, ends)
    slot = (hashes % np.uint64(WORDS)).astype(np.int64)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    key, count = np.unique(owner * WORDS + slot, return_counts=True)
    doc, slot = key // WORDS, key % WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=docs))
    value = value / norm[doc] if len(doc) else value
    distinct = np.bincount(doc, minlength=docs)

    size = np.diff(offs)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    lines = byte_counts(data == 10, offs) + 1
    tail = np.bincount(owner, _SYMBOL[data[ends - 1]], minlength=docs) if len(ends) else np.zeros(docs)
    alone = np.bincount(owner, (ends - starts) == 1, minlength=docs) if len(ends) else np.zeros(docs)
    letters = np.bincount(owner, ends - starts, minlength=docs) if len(ends) else np.zeros(docs)
    continuing = byte_counts((data & 0xC0) == 0x80, offs)  # characters = bytes - continuation bytes
    stated = np.abs(n_chars - (size - continuing)) * per_byte
    stats = [
        np.minimum(BINS - 1, np.log2(size + 1)).astype(np.int64),
        _bin(letters * per_word, 24),
        np.minimum(BINS - 1, np.log2(words / lines + 1) * 2).astype(np.int64),
        _bin(byte_counts(_SYMBOL[data], offs) * per_byte, 1),
        _bin(byte_counts(_DIGIT[data], offs) * per_byte, 1),
        _bin(byte_counts(_CAPITAL[data], offs) * per_byte, 1),
        _bin(byte_counts(_SPACE[data], offs) * per_byte, 1),
        _bin(tail * per_word, 1),
        _bin(alone * per_word, 1),
        _bin(distinct * per_word, 1),
        _bin(np.bincount(owner, again, minlength=docs) * per_word, 1),
        np.where(n_chars < 0, 0, 1 + np.minimum(BINS - 2, _bin(stated, 1))),
    ]
    structure = np.concatenate([WORDS + i * BINS + s for i, s in enumerate(stats)])
    every = np.tile(np.arange(docs), len(stats))
    order = np.argsort(np.concatenate([doc, every]), kind="stable")
    index = np.concatenate([slot, structure])[order]
    values = np.concatenate([value, np.full(len(structure), 1 / np.sqrt(len(stats)))])[order].astype(np.float32)
    return index, values, np.concatenate([[0], np.cumsum(distinct + len(stats))])


def featurise(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse documents of a batch with ``text`` and ``n_chars``, piece by piece."""
    chars = np.array(batch.column("n_chars").fill_null(-1))
    for a, b, data, offs in text_slices(batch.column("text"), SLICE):
        yield a, b, *_sparse(data, offs, chars[a:b])


@dataclass
class Model:
    bias: float
    w: np.ndarray  # DIMS
    v: np.ndarray  # DIMS x RANK

    def logits(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Linear part and the sum-of-squares identity, summed per document; every document has coordinates."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, first[:-1])
        squares = np.add.reduceat(vx * vx, first[:-1])
        return self.bias + np.add.reduceat(self.w[index] * value, first[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(indices: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> Model:
    """AdaGrad over mini-batches; sums run per coordinate of the batch, so a step is linear in the batch."""
    rng = np.random.default_rng(8)
    m = Model(0.0, np.zeros(DIMS), rng.normal(0, 0.02, (DIMS, RANK)))
    gw, gv, gb = np.full(DIMS, 1e-6), np.full((DIMS, RANK), 1e-6), 1e-6
    if len(labels):
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        m.bias = float(np.log(rate / (1 - rate)))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(labels)))) if len(labels) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            index, value = np.concatenate([indices[r] for r in rows]), np.concatenate([values[r] for r in rows])
            sizes = np.array([len(indices[r]) for r in rows])
            first = np.concatenate([[0], np.cumsum(sizes)])
            err = (_sigmoid(m.logits(index, value, first)) - labels[rows]) / len(rows)
            e = np.repeat(err, sizes)
            vx = m.v[index] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, first[:-1]), sizes, axis=0)
            touched, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, e * value, minlength=len(touched)) + DECAY * m.w[touched]
            flow = (e * value)[:, None] * (sums - vx)
            dv = np.stack([np.bincount(inverse, flow[:, f], minlength=len(touched)) for f in range(RANK)], axis=1) + DECAY * m.v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            m.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            m.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            gb += err.sum() ** 2
            m.bias -= RATE * err.sum() / np.sqrt(gb)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: CRC-32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame, *extra: str) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(*extra, "text", stated.alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``index, value, label`` of the sampled labelled documents; ``sample`` labels at most are broadcast, so texts do not move.

    Ids that repeat in ``docs`` give more rows than labels: then each row stays with the probability that leaves ``sample`` of them, by a hash of its place.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64(F.col("doc_id")), "doc_id", "label"]
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("label")).distinct().orderBy(*order).limit(sample)
    rows = _inputs(docs.where("doc_id is not null"), "doc_id").join(F.broadcast(chosen), "doc_id")
    found = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count()
    if found > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id"), F.lit(1 << 30)) < int(sample / found * (1 << 30)))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, index, value, first in featurise(batch):
                cut = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((index, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), *lists, batch.column("label")[a:b]], ["doc_id", "index", "value", "label"])

    return rows.mapInArrow(turn, "doc_id long, index array<int>, value array<float>, label int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit in one task on the bounded sample; only the parameters come to the driver."""

    def learn(t: pa.Table) -> pa.Table:
        order = np.lexsort([[len(x) for x in t["index"]], np.array(t["label"]), np.array(t["doc_id"])])
        t = t.take(order)
        m = fit([np.array(x.values) for x in t["index"]], [np.array(x.values) for x in t["value"]], np.array(t["label"], np.float64))
        return pa.table({"bias": [m.bias], "w": [m.w.astype(np.float32).tobytes()], "v": [m.v.astype(np.float32).tobytes()]})

    rows = stored(training_rows(docs, labels, sample), "quality-sample")
    fitted = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "bias double, w binary, v binary").collect()
    if not fitted:
        return Model(0.0, np.zeros(DIMS, np.float32), np.zeros((DIMS, RANK), np.float32))
    return Model(fitted[0].bias, np.frombuffer(fitted[0].w, np.float32), np.frombuffer(fitted[0].v, np.float32).reshape(DIMS, RANK))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` that are asked for stay out of the model: ``doc_id, score, predicted`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, *sparse in featurise(batch):
                s = _sigmoid(model.logits(*sparse)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return _inputs(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns kept: a filter, no shuffle."""

    @F.pandas_udf("boolean")
    def accept(text, n_chars):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True), pa.array(n_chars.fillna(-1).astype("int64"), pa.int64())], ["text", "n_chars"])
        parts = [_sigmoid(model.logits(*sparse)) >= threshold for _, _, *sparse in featurise(batch)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.where(accept("text", stated))
