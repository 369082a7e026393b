"""Token counts of whole documents by the library of a vocabulary file: lengths come back, ids never do.

Texts are split at safe boundaries: before an ASCII blank, tab or line end that follows a character that is certainly not white space. No
pre-token of the byte-level pattern holds a character and white space behind it, and a special string holds no white space,
so the pieces' counts add up to the count of the whole (``byte_level=True``). A very long text is thus never encoded whole. Equal pieces of a
batch are encoded once. Pieces go to the encoder in batches of about equal bytes; what comes back is a count per piece, then a
sum per document. A file of another kind (sentencepiece, or a tokenizer whose pattern crosses blanks) is encoded text by text.

Everything is local to a row, so nothing is shuffled and a lost executor costs its own partitions.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows are counted each; special strings inside a text count as the
library has them by default; an unbroken run without a safe boundary is encoded whole, however long; an empty table gives no rows. Other
columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.words import text_slices

LIMIT = 1024
#: Bytes of text whose pieces are counted together, and of distinct pieces that the encoder is given at once.
SLICE_BYTES = 16 << 20
BATCH_BYTES = 1 << 20

#: Last bytes of white space outside ASCII, and the bytes that can stand before them there.
_WHITE_LAST = np.zeros(256, bool)
_WHITE_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WHITE_BEFORE = np.zeros(256, bool)
_WHITE_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0D]] = True
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    # Spark runs a worker per core already
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def safe_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where a piece begins, over all documents of a slice: safe boundaries and the documents' own begins."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before = data[:-1]
        graphic = (before > 0x20) & (before < 0x7F)
        wide = before >= 0x80
        wide[1:] &= ~(_WHITE_LAST[before[1:]] & _WHITE_BEFORE[data[:-2]])
        cut[1:-1] = _GAP[data[1:]] & (graphic | wide)
    cut[offs[:-1]] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def _batches(texts: list[str], sizes: np.ndarray) -> Iterator[list[str]]:
    """Runs of texts of about ``BATCH_BYTES``."""
    share = np.cumsum(sizes) // BATCH_BYTES
    for a, b in zip(*(lambda at: (at, [*at[1:], len(texts)]))(np.flatnonzero(np.diff(share, prepend=-1)).tolist())):
        yield texts[a:b]


def slice_counts(data: np.ndarray, offs: np.ndarray, count: Callable[[list[str]], list[int]], byte_level: bool) -> np.ndarray:
    """Tokens of each document of a slice."""
    begins = safe_cuts(data, offs) if byte_level else np.unique(offs[:-1][offs[:-1] < len(data)])
    if not len(begins):
        return np.zeros(len(offs) - 1, np.int64)
    bounds = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
    pieces = pa.LargeStringArray.from_buffers(len(begins), bounds, pa.py_buffer(np.ascontiguousarray(data)))
    coded = pieces.dictionary_encode()
    sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
    tokens = np.array([n for part in _batches(coded.dictionary.to_pylist(), sizes) for n in count(part)], np.int64)
    sums = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy(zero_copy_only=False)])])
    edge = np.searchsorted(begins, offs)
    return sums[edge[1:]] - sums[edge[:-1]]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, byte_level: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row. ``byte_level`` says that pieces may be cut at safe boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(1), SLICE_BYTES):
                tokens = slice_counts(data, offs, count, byte_level)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(offs)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
