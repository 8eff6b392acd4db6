"""What several operators share: words, text hashes, positions in an order, byte-sized batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import materialize

#: Fixed by the contracts: words are runs of anything but these six characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Documents handled together by vectorised code, in bytes of text.
GROUP_BYTES = 2 << 20
MIN_LONG = -(1 << 63)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.filter(F.split(trimmed, SPACE_RUN), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def even_pieces(rows: int) -> int:
    """Pieces to deal rows into so that neither the pieces nor the rows of one grow beyond the square root."""
    return max(1, math.isqrt(rows))


def numbered(df: DataFrame, order: list[Column], name: str, rows_per_piece: int = 200_000) -> DataFrame:
    """Add the 0-based place of every row in a total order.

    Rows are dealt to ranges of the order, stored with the number of their range, counted, and numbered
    inside their range only; equal rows are numbered in any order. The ranges follow the row count.
    """
    pieces = max(1, -(-df.count() // rows_per_piece))
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.select(F.struct("*").alias("_row"), *[o.alias(k) for o, k in zip(order, keys)])
    # one row orders before another by the same rule in every step: nulls first, then the value
    ranged = materialize(ranged.repartitionByRange(pieces, *keys).withColumn("_piece", F.spark_partition_id()))
    counts = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_piece").orderBy(*keys)) - 1
    return ranged.join(offsets, "_piece").withColumn(name, place.cast("long")).select("_row.*", name)


#: What Python workers keep between tasks, as functions that let it go.
_memos: list[Callable[[], None]] = []


def keeps_memo(forget: Callable[[], None]) -> None:
    if forget not in _memos:
        _memos.append(forget)


def free_memos() -> None:
    """For operators that need a worker's memory for themselves: let go what others keep in it."""
    for forget in _memos:
        forget()


def text_groups(batches: Iterator[pa.RecordBatch], group_bytes: int = GROUP_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Cut (key, binary text) batches into groups of about as many bytes each; a long text stands alone."""
    for batch in batches:
        key, texts = batch.column(0), batch.column(1).to_pylist()
        first = size = 0
        for i, t in enumerate(texts):
            here = len(t) if t else 0
            if size and size + here > group_bytes:
                yield key.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += here
        if first < len(texts):
            yield key.slice(first), texts[first:]


# --- hashes of words, vectorised over the bytes of a group of documents --------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE_BYTES = 1 << 16
#: One random number per byte value, so that no text structure survives in the sums.
_BYTE = np.random.default_rng(20_011).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the base and of its inverse, which an odd number has modulo 2^64.
_POWERS, _INVERSES = powers(_SLICE_BYTES), powers(_SLICE_BYTES, np.uint64(pow(int(_BASE), -1, 1 << 64)))


class Words:
    """The words of a group of documents: hash, first byte, end, document, and the first word of each document."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        inside = (self.data != 32) & (self.data - np.uint8(9) > 4)  # below 9 the difference wraps around
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self, slice_bytes: int = _SLICE_BYTES) -> np.ndarray:
        """Sum of each word's bytes times powers of the base, as differences of running sums over slices.

        Slices end between words, so that memory does not follow the length of a text.
        """
        out, at, n = np.empty(len(self.start), np.uint64), 0, len(self.start)
        while at < n:
            lo = int(self.start[at])
            upto = max(at + 1, int(np.searchsorted(self.end, lo + slice_bytes, "right")))
            size = int(self.end[upto - 1]) - lo
            table = _POWERS[:size] if size <= len(_POWERS) else powers(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo : lo + size]] * table, out=sums[1:])
            start = self.start[at:upto] - lo
            out[at:upto] = (sums[self.end[at:upto] - lo] - sums[start]) * _INVERSES[start]
            at = upto
        return mixed(out ^ (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; the last k - 1 of the group have none."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(k, np.uint64(0xD1342543DE82EF95))):
            out += self.hash[j : j + n] * p
        return mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Which of :meth:`grams` lie in one document."""
        n = max(0, len(self.hash) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def key_column(name: str) -> Column:
    """An id as a number that is never null: a null id counts as the smallest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(MIN_LONG))


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_doc`` (the whole row) and ``_key``, one number for every distinct id and text.

    Numbers order as the ids do, a null id first, then by hashes of the text. They are the ids themselves
    unless an id (or null) has several texts; only then are ids and hashes numbered anew, and rows stored.
    """
    rows = docs.select(F.struct("*").alias("_doc"), key_column(key).alias("_key"))
    body = F.col("_doc").getField(text)
    told = rows.select("_key", F.xxhash64(body).alias("_h"), F.coalesce(F.crc32(body.cast("binary")), F.lit(-1)).alias("_c"))
    several = F.min(F.struct("_h", "_c")) != F.max(F.struct("_h", "_c"))
    if told.groupBy("_key").agg(several.alias("_several")).filter("_several").isEmpty():
        return rows
    numbers = numbered(materialize(told.distinct()), [F.col("_key"), F.col("_h"), F.col("_c")], "_number")
    rows = rows.withColumns({"_h": F.xxhash64(body), "_c": F.coalesce(F.crc32(body.cast("binary")), F.lit(-1))})
    return materialize(rows.join(numbers, ["_key", "_h", "_c"]).select("_doc", F.col("_number").alias("_key")))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes each as hold them all."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all the next, so that the high ones, mostly equal, compress to little."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, size: int = 8) -> np.ndarray:
    """The numbers of ``size`` bytes each that :func:`planes` wrote."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"i{size}").ravel()


#: Places in the bitmap of :func:`with_mark`, 1 MB.
MARKS = 1 << 23


def with_mark(rows: DataFrame, chosen: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``_marked``: true where ``chosen`` has the columns ``by``, and on few others.

    A bitmap of fixed size tells, so that not all rows are shuffled for some.
    """
    place = F.pmod(F.xxhash64(*by), F.lit(MARKS))
    bits = chosen.select(place.alias("_place")).groupBy(F.expr("shiftright(_place, 15)").alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.expr("_place & 32767")).alias("_bits"))
    placed = rows.withColumn("_place", place).withColumn("_part", F.expr("shiftright(_place, 15)"))
    byte = "conv(hex(substring(_bits, cast(shiftright(_place & 32767, 3) + 1 as int), 1)), 16, 10)"
    is_set = F.coalesce(F.expr(f"shiftright(cast({byte} as int), cast(_place & 7 as int)) & 1 = 1"), F.lit(False))
    return placed.join(F.broadcast(bits), "_part", "left").select(*rows.columns, is_set.alias("_marked"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0)
