"""Substring dedup by parsing documents relative to an index of everything that comes before.

The index is the whole table, cut into reference blocks: a window of ``window`` words belongs to the block
named by its anchor, the smallest hash among its shorter word runs, so equal windows meet in one block and
neighbouring windows mostly share one. A block knows the first start of each of its windows. A document is
factored greedily against all blocks: a factor runs on while the next window's first start is the next
word of the same reference, and where that stops, at the factor's boundary, the next factor is looked up
anew. Every factor is at least a window long and becomes a duplicate span of the document.

A task meets a window many times but sends it once, so a passage that half of all documents contain
costs its block one row per task. Windows are compared by 64-bit hashes of their words, within a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import Words, identified, text_bytes, text_groups

WINDOW, ANCHOR = 20, 8
#: Text per reference block, and windows a task holds before it sends them.
BLOCK_BYTES, HELD_WINDOWS = 3 << 20, 1_000_000
_SENT = "block int, hashes binary, run_key binary, run_start binary, run_n binary, hit_key binary, hit_start binary, hit_n binary, hit_ref binary, hit_ref_start binary"
_SPANS = "_key long, start int, n int, ref_key long, ref_start int"


def _runs(key: np.ndarray, start: np.ndarray, *aligned: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of runs of consecutive starts in one document (and in one reference)."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    on = (key[1:] == key[:-1]) & (start[1:] == start[:-1] + 1)
    for k, s in aligned:
        on &= (k[1:] == k[:-1]) & (s[1:] == s[:-1] + 1)
    head = np.flatnonzero(np.concatenate(([True], ~on)))
    return head, np.diff(np.append(head, len(key))).astype(np.int32)


def first_starts(w: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows in any order: which are sent on (one per hash), and the places of later ones with their first."""
    order = np.argsort(w, kind="stable")
    sw = w[order]
    same = np.concatenate(([False], sw[1:] == sw[:-1]))
    member = same | np.concatenate((same[1:], [False]))
    repeated = order[member]
    # only repeated windows need the full order by document and start
    repeated = repeated[np.lexsort((start[repeated], key[repeated], w[repeated]))]
    head = np.concatenate(([True], w[repeated][1:] != w[repeated][:-1])) if len(repeated) else np.zeros(0, bool)
    firsts = repeated[head]
    ref = np.repeat(firsts, np.diff(np.append(np.flatnonzero(head), len(repeated)))) if len(repeated) else repeated
    later = (key[repeated] != key[ref]) | (start[repeated] != start[ref])
    return np.concatenate((order[~member], firsts)), repeated[later], ref[later]


def _hits(key, start, at, ref) -> list[np.ndarray]:
    order = np.lexsort((start[at], key[at]))
    at, ref = at[order], ref[order]
    k, s, rk, rs = key[at], start[at], key[ref], start[ref]
    head, n = _runs(k, s, (rk, rs))
    return [k[head], s[head], n, rk[head], rs[head]]


def _send(held: list[tuple[np.ndarray, ...]], blocks: int, task_turn: int) -> Iterator[pa.RecordBatch]:
    w, block, key, start = (np.concatenate(x) for x in zip(*held))
    kept, at, ref = first_starts(w, key, start)
    kept.sort()
    kept = kept[np.argsort(block[kept], kind="stable")]
    edges = np.flatnonzero(np.concatenate(([True], np.diff(block[kept]) != 0, [True]))) if len(kept) else np.zeros(1, int)
    rows = []
    none = [b""] * 5
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = kept[lo:hi]
        head, n = _runs(key[part], start[part])
        rows.append((int(block[part[0]]), w[part].tobytes(), key[part][head].tobytes(), start[part][head].tobytes(), n.tobytes(), *none))
    hits = _hits(key, start, at, ref)
    for lo in range(0, len(hits[0]), 100_000):
        turn = (task_turn + lo // 100_000) % blocks
        rows.append((turn, b"", b"", b"", b"", *(x[lo : lo + 100_000].tobytes() for x in hits)))
    names = [f.split()[0] for f in _SENT.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 9]
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 64]), types)], names=names)


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _meet(table: pa.Table) -> pa.Table:
    w = _numbers(table["hashes"], np.uint64)
    run_key, run_start = _numbers(table["run_key"], np.int64), _numbers(table["run_start"], np.int32)
    n = _numbers(table["run_n"], np.int32)
    heads = np.cumsum(n) - n
    key = np.repeat(run_key, n)
    start = (np.repeat(run_start, n) + (np.arange(len(key)) - np.repeat(heads, n))).astype(np.int32)
    _, at, ref = first_starts(w, key, start)
    found = _hits(key, start, at, ref)
    kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
    sent = [_numbers(table[c], k) for c, k in zip(("hit_key", "hit_start", "hit_n", "hit_ref", "hit_ref_start"), kinds)]
    names = [f.split()[0] for f in _SPANS.split(", ")]
    return pa.table([np.concatenate(x) for x in zip(found, sent)], names=names)


def window_hits(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """Runs of windows that also start earlier: ``_key, start, n, ref_key, ref_start``.

    ``docs`` holds ``_key`` (a number) and ``text``.
    """
    blocks = max(1, -(-text_bytes(docs) // block_bytes))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 7 * TaskContext.get().partitionId()
        for keys, texts in text_groups(batches):
            group = Words(texts)
            inside = np.flatnonzero(group.whole(window))
            if not len(inside):
                continue
            short = group.grams(anchor)
            choices = np.lib.stride_tricks.sliding_window_view(short, window - anchor + 1)
            least = choices.min(axis=1)[inside]
            ids = np.asarray(keys.to_numpy(zero_copy_only=False), np.int64)
            doc = group.doc[inside]
            held.append(
                (
                    group.grams(window)[inside],
                    (least % np.uint64(blocks)).astype(np.int32),
                    ids[doc],
                    (inside - group.first[doc]).astype(np.int32),
                )
            )
            size += len(inside)
            if size >= held_windows:
                yield from _send(held, blocks, turn)
                turn += 7
                held, size = [], 0
        if held:
            yield from _send(held, blocks, turn)

    sent = docs.select("_key", F.col("text").cast("binary")).mapInArrow(scatter, _SENT)
    return sent.groupBy("block").applyInArrow(_meet, _SPANS)


def factors(hits: DataFrame, window: int = WINDOW) -> DataFrame:
    """Greedy factors ``_key, start, length, ref_key, ref_start`` in words, each at least a window long."""
    order = Window.partitionBy("_key").orderBy("start", "n")
    before = [F.lag(c).over(order) for c in ("start", "n", "ref_key", "ref_start")]
    goes_on = (
        (F.col("start") == before[0] + before[1])
        & (F.col("ref_key") == before[2])
        & (F.col("ref_start") == before[3] + before[1])
    )
    marked = hits.withColumn("_new", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("_factor", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("_key", "_factor")
        .agg(
            F.min("start").alias("start"),
            (F.sum("n") + window - 1).cast("int").alias("length"),
            F.min_by("ref_key", "start").alias("ref_key"),
            F.min("ref_start").alias("ref_start"),
        )
        .drop("_factor")
    )


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """``key, n_words, n_removed, kept`` for every row: the text without the words of duplicate spans.

    A word goes if one of its windows also starts earlier: in a document of smaller key, or earlier in its
    own. Kept words are joined by one space. Null and short texts have no windows. A null key counts as the
    smallest; different texts under one key, or without one, are different documents, in a fixed order, and
    equal ones the same document, none earlier than the other. No rows give no rows.
    """
    rows, body = identified(docs.select(key, text), key, text), F.col("_doc").getField(text)
    source = rows.select(F.col("_doc").getField(key).alias("_id"), "_key", F.coalesce(body, F.lit("")).alias("text"))
    spans = (
        factors(window_hits(source, window, **options), window)
        .groupBy("_key")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    )
    joined = source.join(spans, "_key", "left").select("_id", F.col("text").cast("binary"), "starts", "lengths")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for t, starts, lengths in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = t.split()
                gone = 0
                if starts:
                    step = np.zeros(len(words) + 1, np.int32)
                    at, end = np.array(starts), np.array(starts) + np.array(lengths)
                    np.add.at(step, np.minimum(at, len(words)), 1)
                    np.add.at(step, np.minimum(end, len(words)), -1)
                    stay = np.cumsum(step[:-1]) == 0
                    gone = int(len(words) - stay.sum())
                    words_left = list(compress(words, stay.tolist()))
                else:
                    words_left = words
                counts.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words_left))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "n_words", "n_removed", "kept"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    out = joined.mapInArrow(strip, f"_id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", key)


def digest(deduped: DataFrame, kept: str = "kept") -> DataFrame:
    """The same rows with the kept text as a SHA-256."""
    return deduped.withColumn("kept_sha256", F.sha2(F.col(kept), 256)).drop(kept)
