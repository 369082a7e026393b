"""Collocations: frequent phrases of two to five words, by Rabin-Karp fingerprints, pruned level by level.

Texts are lower-cased (A-Z), split into pieces at sentence marks and line ends, pieces into words at blanks. In numpy every word gets a 64-bit
code, prefix polynomials over the codes give the fingerprint of every n-gram of a slice in one subtraction and one product. Nothing
but (fingerprint, count) is shuffled, after equal fingerprints of a slice were added up.

1. *Count.* Level by level, n-grams of k words are counted by fingerprint, but only where both parts of k - 1 words may be frequent. What is
   frequent reaches the tasks as a bitmap of at most ``CELLS`` bits (64 per fingerprint while they are few). A bitmap is filled by at most
   ``PER_BITMAP`` fingerprints; when a level has more, its fingerprints are dealt into several bitmaps and the next level is counted in as many rounds,
   each for the n-grams whose first part is dealt to its bitmap. Bitmaps err only by letting an n-gram through.
2. *Verify.* One more pass reads all texts (one per ``TOGETHER`` bitmaps). N-grams whose fingerprint may be frequent are grouped by their words: words of equal
   code are compared byte by byte, n-grams of equal fingerprint word by word, each against the occurrence that stands for it. A group
   leaves the task as its phrase, count and an occurrence pointer (document, byte); phrases, not fingerprints, are summed, so collisions part here.
   Only frequent fingerprints are ever written out as text.
3. *Score.* Parts of a frequent phrase are at least as frequent, so scores are joins of the phrase table with itself, in decimals of
   38 digits. A phrase inside a longer one of the same count is dropped.

Defined cases: null and empty texts have no words; a null lang is ``und`` (together with texts marked so); repeated rows count each; very long
texts are cut at word ends with the words that a phrase may still need; ties of a score go to fewer words in the first part; an empty table or one without
frequent phrases gives no rows. Other columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebank.llm.common import stored
from lorebank.llm.words import mix64, word_codes

LONGEST = 5
LEAST = 100
TOP = 2000
#: A phrase is dropped if a longer one around it has at least this share of its count.
INSIDE_PERCENT = 100
#: Bytes of text handled together; most bits of a bitmap (a power of two) and fingerprints that may fill it; bitmaps of a verifying pass.
SLICE = 4 << 20
CELLS = 1 << 28
PER_BITMAP = 1 << 26
TOGETHER = 5

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The base of the polynomials, 3 modulo 4, so that swapped words differ in all but one bit's chance.
_BASE = 0x9E3779B97F4A7C17
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base % 2**64, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


class Slice:
    """Words of some bytes of text: places, codes, and how many more words of its piece each word has behind it."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, seed: np.ndarray, place: np.ndarray, limit: np.ndarray, offs: np.ndarray) -> None:
        """``owner``, ``seed``, ``place`` and ``limit`` hold, per text of the slice, its row, the code of its language, the
        byte at which it begins in its document, and the bytes whose words may begin a phrase."""
        self.data = _LOWER[data]
        gap, stop = _GAP[data], _BREAK[data]
        solid = ~gap
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= gap[:-1]
        end[:-1] &= gap[1:]
        edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
        begin[edge] = solid[edge]
        end[edge - 1] = solid[edge - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        text = np.searchsorted(offs, self.starts, "right") - 1
        self.text, self.owner, self.seed, self.place, self.offs = text, owner, seed, place, offs
        self.may_begin = self.starts - offs[text] < limit[text]
        # a piece ends at a break or with its text; words up to the next piece's first word belong together
        breaks = np.concatenate([[0], np.cumsum(stop)])
        piece = breaks[self.starts]
        last = np.ones(len(piece), bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        lasts = np.flatnonzero(last)
        self.left = lasts[np.searchsorted(lasts, np.arange(len(piece)))] - np.arange(len(piece)) if len(piece) else np.zeros(0, np.int64)
        self.code = word_codes(self.data, self.starts, self.ends)
        up = _powers(_BASE, len(piece) + 1)
        self.down = _powers(pow(_BASE, -1, 2**64), len(piece) + 1)
        self.sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(self.code * up[:-1], out=self.sums[1:], dtype=np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Words that begin an n-gram of ``k`` words."""
        return np.flatnonzero((self.left >= k - 1) & self.may_begin)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the ``k`` words from each word of ``at``, with language and length."""
        poly = (self.sums[at + k] - self.sums[at]) * self.down[at]
        return mix64(poly ^ self.seed[self.text[at]] ^ np.uint64(k * 0x2545F4914F6CDD1D % 2**64))

    def word_ids(self) -> np.ndarray:
        """A number per word, equal only for words that are equal byte by byte."""
        _, first, ids = np.unique(self.code, return_index=True, return_inverse=True)
        own, model = self._same_bytes(np.arange(len(ids)), first[ids])
        for i in np.flatnonzero(~own):  # words of equal code and different bytes: numbers of their own by content
            ids[i] = len(first) + model.setdefault(self.data[self.starts[i] : self.ends[i]].tobytes(), len(model))
        return ids

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[bytes, int]]:
        size = self.ends[a] - self.starts[a]
        same = size == self.ends[b] - self.starts[b]
        a, b, size = a[same], b[same], size[same]
        cut = np.concatenate([[0], np.cumsum(size)])
        unlike = np.zeros(len(size), bool)
        step = 1 << 22
        begin = 0
        while begin < len(size):  # some bytes at a time
            stop = max(begin + 1, int(np.searchsorted(cut, cut[begin] + step, "right")) - 1)
            n, base = size[begin:stop], cut[begin:stop] - cut[begin]
            inside = np.arange(cut[stop] - cut[begin]) - np.repeat(base, n)
            differ = self.data[np.repeat(self.starts[a[begin:stop]], n) + inside] != self.data[np.repeat(self.starts[b[begin:stop]], n) + inside]
            unlike[begin:stop] = np.logical_or.reduceat(differ, base)
            begin = stop
        same[same] = ~unlike
        return same, {}

    def phrase(self, word: int, k: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(word, word + k))


def language_seed(lang: str) -> int:
    """64 bits that part the fingerprints of languages."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def _cuts(data: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """``begin, end, end with the words that may still be needed`` of the parts of one text, cut where a word ends."""
    parts, begin, gap = [], 0, None
    while len(data) - begin > size:
        if gap is None:
            gap = np.flatnonzero(_GAP[data])
        at = int(np.searchsorted(gap, begin + size, "right"))
        if at and gap[at - 1] > begin:
            end = int(gap[at - 1])
        elif at < len(gap):  # one word longer than a slice
            end = int(gap[at])
        else:
            break
        # words begin where a gap byte is followed by none; the next words end at the gaps behind them
        tail, words = end, 0
        while tail < len(data) and words < LONGEST:
            reach = data[tail : tail + (1 << 12)]
            solid = ~_GAP[reach]
            words += int(np.count_nonzero(solid[1:] & ~solid[:-1]))
            tail += len(reach)
        while tail < len(data) and not _GAP[data[tail]]:
            tail = int(gap[np.searchsorted(gap, tail)]) if tail <= gap[-1] else len(data)
        parts.append((begin, end, tail))
        begin = end
    return [*parts, (begin, len(data), len(data))]


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Slice, list[str], pa.Array]]:
    """Slices of about ``size`` bytes over the batches (lang, text, and row names if any), with language and name per row."""
    langs: list[str] = []
    names: list = []
    parts: list[tuple] = []
    held = 0

    def made() -> tuple[Slice, list[str], list]:
        data = np.concatenate([p[0] for p in parts])
        offs = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        owner, place, limit = (np.array([p[i] for p in parts], np.int64) for i in (1, 2, 3))
        seeds = {lang: language_seed(lang) for lang in set(langs)}
        return Slice(data, owner, np.array([seeds[langs[i]] for i in owner], np.uint64), place, limit, offs), langs, names

    for batch in batches:
        text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        _, at, raw = text.buffers()
        at = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lang = pc.fill_null(batch.column("lang"), "und").to_pylist()
        ident = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else lang
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            whole = raw[a:b]
            for begin, end, tail in _cuts(whole, size) if b - a > size else [(0, b - a, b - a)]:
                if parts and held + tail - begin > size:
                    yield made()
                    langs, names, parts, held = [], [], [], 0
                parts.append((whole[begin:tail].copy() if b - a <= size else whole[begin:tail], len(langs), begin, end - begin))
                langs.append(lang[i])
                names.append(ident[i])
                held += tail - begin
    if parts:
        yield made()


def passes(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Fingerprints whose cell is set."""
    cell = prints & np.uint64(8 * bitmap.nbytes - 1)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) != 0


def _dealt(prints: np.ndarray, rounds: int) -> np.ndarray:
    """The bitmap that each fingerprint is dealt to, by bits that its cell does not use."""
    return (prints >> np.uint64(40)) % np.uint64(rounds)


def bitmaps(hot: DataFrame, cells: int, per_bitmap: int) -> list[np.ndarray]:
    """The fingerprints ``fp`` as bitmaps, packed by Spark; a bitmap comes to the driver as at most ``cells / 64`` numbers."""
    n = hot.count()
    rounds = max(1, -(-n // per_bitmap))
    cells = min(cells, 64 << n.bit_length())
    # the same deal as _dealt, on signed numbers
    deal = F.pmod(F.shiftrightunsigned("fp", 40), F.lit(rounds)).cast("int")
    cell = F.col("fp").bitwiseAND(cells - 1)
    bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    packed = hot.select(deal.alias("deal"), cell.alias("cell")).groupBy("deal", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    maps = []
    for i in range(rounds):
        rows = packed.where(F.col("deal") == i).select("word", "bits").toArrow()
        one = np.zeros(cells // 64, np.uint64)
        one[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        maps.append(one)
    return maps


def _level(docs: DataFrame, k: int, before: list[np.ndarray], least: int, size: int) -> DataFrame:
    """``fp`` of every n-gram fingerprint of ``k`` words that occurs ``least`` times, stored."""
    spark, rounds = docs.sparkSession, len(before)
    counted = []
    for i in range(max(1, rounds)):
        shipped = spark.sparkContext.broadcast(before[i]) if before else None

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, i=i) -> Iterator[pa.RecordBatch]:
            for part, _, _ in slices(batches, size):
                at = part.grams(k)
                if shipped is not None:
                    first = part.prints(at, k - 1)
                    ok = passes(shipped.value, first)
                    if rounds > 1:
                        ok &= _dealt(first, rounds) == i
                    else:
                        ok[ok] = passes(shipped.value, part.prints(at[ok] + 1, k - 1))
                    at = at[ok]
                prints, n = np.unique(part.prints(at, k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n)], ["fp", "n"])

        counted.append(docs.select("lang", "text").mapInArrow(run, "fp long, n long"))
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    return stored(rows.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp"), f"phrase-prints-{k}")


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = SLICE, cells: int = CELLS, per_bitmap: int = PER_BITMAP) -> DataFrame:
    """``lang, k, phrase, f, doc_id, at`` of every phrase of 1 to ``longest`` words that occurs ``least`` times in its language, with one place of it
    (smallest document, first byte there). Row ``k = 0`` of a language counts all its words. Stored."""
    spark = docs.sparkSession
    if longest > LONGEST:
        raise ValueError(f"phrases of more than {LONGEST} words are not cut right in very long texts")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    levels, before = [], []
    for k in range(1, longest + 1):
        before = bitmaps(_level(docs, k, before, least, size), cells, per_bitmap)
        levels.append(before)
        if not any(m.any() for m in before):
            break
    jobs = [(n + 1, i, len(kept), bitmap) for n, kept in enumerate(levels) for i, bitmap in enumerate(kept)]
    found = [_verified(docs, [(*j[:3], spark.sparkContext.broadcast(j[3])) for j in jobs[a : a + TOGETHER]], size) for a in range(0, len(jobs), TOGETHER)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # a language's words are counted in the first round of level 1 alone
    total = rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"), F.min(F.struct("doc_id", "at")).alias("first"))
    total = total.where((F.col("k") == 0) | (F.col("f") >= least))
    return stored(total.select("lang", "k", "phrase", "f", "first.doc_id", "first.at"), "phrases")


def _verified(docs: DataFrame, jobs: list[tuple], size: int) -> DataFrame:
    """Phrases behind the fingerprints of the bitmaps (words, number of the bitmap, bitmaps of the level, bitmap), counted by their words, per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, names in slices(batches, size):
            ids = part.word_ids()
            lang = np.unique(np.array(langs, object), return_inverse=True)[1]
            for k, i, rounds, shipped in jobs:
                at = part.grams(k)
                prints = part.prints(at, k)
                ok = passes(shipped.value, prints)
                if rounds > 1:
                    ok &= _dealt(prints, rounds) == i
                at, n = _groups(part, at[ok], prints[ok], ids, lang, k)
                text = part.text[at]
                owner = part.owner[text].tolist()
                rows = [
                    [langs[j] for j in owner],
                    [k] * len(at),
                    [part.phrase(w, k).decode() for w in at.tolist()],
                    n.tolist(),
                    [names[j] for j in owner],
                    (part.place[text] + part.starts[at] - part.offs[text]).tolist(),
                ]
                if k == 1 and i == 0:
                    whole = part.owner[part.text[part.may_begin]]
                    for j, m in enumerate(np.bincount(lang[whole], minlength=int(lang.max()) + 1).tolist()):
                        for column, value in zip(rows, (langs[int(np.argmax(lang == j))], 0, "", m, None, None)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _FOUND)], _FOUND.names)

    return docs.mapInArrow(run, "lang string, k int, phrase string, n long, doc_id long, at long")


def _groups(part: Slice, at: np.ndarray, prints: np.ndarray, ids: np.ndarray, lang: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each different phrase among the n-grams ``at``, and how often it occurs there.

    Members of a fingerprint whose words or language differ from its first member's are grouped by their words.
    """
    if not len(at):
        return at, at
    lang = lang[part.owner[part.text[at]]]
    _, first, group = np.unique(prints, return_index=True, return_inverse=True)
    model = first[group]
    unlike = lang != lang[model]
    for j in range(k):
        unlike |= ids[at + j] != ids[at[model] + j]
    other: dict[tuple, int] = {}
    for j in np.flatnonzero(unlike).tolist():
        group[j] = other.setdefault((lang[j], *ids[at[j] : at[j] + k].tolist()), len(first) + len(other))
    order = np.argsort(group, kind="stable")
    heads = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
    return at[heads], np.bincount(group)[group[heads]]


_FOUND = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


def scored(phrases: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``lang, phrase, a, l, r, n, score, doc_id, at`` of the phrases that no longer one contains as often."""
    f = phrases.where("k > 0").select("lang", "phrase", "f")
    several = phrases.where("k > 1").withColumn("words", F.split("phrase", " ", -1))
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    # every shorter phrase of at least two words inside a phrase
    spans = F.explode(F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), a -> array_join(slice(words, a, n), ' '))))"))
    around = several.where("k > 2").select("lang", spans.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = several.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "doc_id", "at", "k", "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "doc_id", "at", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    total = phrases.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    exact = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    cuts = cuts.join(total, "lang").withColumn("score", exact)
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "cut")).alias("best")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), best).select("lang", "phrase", "a", "best.*", "doc_id", "at")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """The best ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score`` and a place (``doc_id``, byte ``at``) of each."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(frequent(docs, longest, least), inside_percent).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "at")
