"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length are interchangeable. Spark
counts them per length; the packing itself runs over these counts (at most one per length, whatever the
input) with a segment tree over remaining capacities that finds the tightest open bin in logarithmic
time; and what it decides for runs of equal documents is joined back as ranges of ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import text_groups
from corpusforge.llm.tokens import encoder
from corpusforge.session import materialize


class OpenBins:
    """Bins by remaining capacity, as ranges of sequence numbers, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += change
            node >>= 1

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.ranges[room].append((first, bins))
            self._count(room, bins)

    def take(self, room: int) -> tuple[int, int]:
        first, bins = self.ranges[room].pop()
        self._count(room, -bins)
        return first, bins

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of an open bin that is at least ``need``."""
        node = self.leaves + need
        if self.tree[node]:
            return need
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, items, first sequence, items per sequence, offset)``.

    Item by item this is best fit: an item goes to the tightest bin it fits, and the next item of the
    same length to that bin again while it fits, because no other bin can be tighter.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = bins.take(room)
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and full < many:
                runs.append((length, rank, left, first + full, left, capacity - room))
                bins.add(room - left * length, first + full, 1)
                used, left = full + 1, 0
            bins.add(room, first + used, many - used)
    return runs


def document_pieces(
    docs: DataFrame, vocabulary_name: str, capacity: int, key: str, text: str, keep_ids: bool
) -> DataFrame:
    """Token pieces of every document, each with its rank among the pieces of its length in its task."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    columns = ["key", "piece", "start", "length", "ids_crc32", "_task", "_local", *(["ids"] if keep_ids else [])]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for keys, texts in text_groups(batches):
            rows, owner = [], []
            for i, ids in enumerate(encoder(vocabulary_name).ids([t or b"" for t in texts])):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((piece, at // 4, n, zlib.crc32(part), task, seen[n], part)[: len(types)])
                    seen[n] += 1
                    owner.append(i)
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *arrays], names=columns)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, _task int, _local long"
    source = docs.select(F.col(key), F.col(text).cast("binary"))
    return source.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def pack(
    docs: DataFrame,
    vocabulary_name: str = "word_bpe_49k.json",
    capacity: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` (and the ids as bytes, if wanted).

    A document is its tokens and the id 0; one longer than the capacity is cut into full pieces and a
    rest. A null text counts as empty and still has its closing id. Repeated rows are packed as often
    as they occur; null keys and further columns do not matter; no rows give no rows.
    """
    pieces = materialize(document_pieces(docs, vocabulary_name, capacity, key, text, keep_ids))
    per_task = materialize(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(
        best_fit_decreasing(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
        "length long, _rank long, _items long, _first long, _each long, _used long",
    )
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "_task"]).withColumn("_k", F.col("_before") + F.col("_local"))
    # the runs are bounded by the capacity, not by the data
    placed = ranked.alias("p").join(
        F.broadcast(runs).alias("r"),
        (F.col("p.length") == F.col("r.length"))
        & (F.col("p._k") >= F.col("r._rank"))
        & (F.col("p._k") < F.col("r._rank") + F.col("r._items")),
    )
    nth = F.col("p._k") - F.col("r._rank")
    return placed.select(
        F.col("p.key").alias(key),
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("r._first") + F.floor(nth / F.col("r._each"))).cast("long").alias("sequence_id"),
        (F.col("r._used") + F.pmod(nth, F.col("r._each")) * F.col("p.length")).cast("long").alias("offset"),
        *(["p.ids"] if keep_ids else []),
    )
