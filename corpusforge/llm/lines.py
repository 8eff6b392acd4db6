"""Line dedup by an exact set-similarity join.

A line's tokens are its runs of five words (a shorter line is one token). Tokens are ordered by rarity;
two lines of Jaccard similarity ``t`` share a token among the rarest ``n - ceil(t n) + 1`` of each, so only
these prefixes meet. Length and positional filters drop candidates, the rest is verified on whole token
sets, and a line that has an earlier match goes. Lines with equal sets are one class, represented by the
first of them; candidates are pairs of such first lines. Rarity is counted over all documents into a fixed
number of counters: it only orders tokens, any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Words, free_memos, from_planes, identified, mixed, narrow, planes, powers, text_groups, with_mark
from corpusforge.session import materialize

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # words in a token; similarity 4/5
COUNTERS, SLICES, SALTS = 1 << 20, 64, 8
BLOCK_BYTES, HELD_ENTRIES = 8 << 20, 1_000_000
#: Partners a line gets from one token at once; lines with more and no match yet get all of them later.
FIRST_PARTNERS = 8


class Lines:
    """Lines with words of a group of documents, and the tokens of each: (line, hash), not yet distinct."""

    def __init__(self, texts: list[bytes | None], wanted: list[list[int]] | None = None):
        w = Words(texts)
        breaks = np.flatnonzero(w.data == 10)
        passed = np.cumsum(np.bincount(np.searchsorted(w.start, breaks), minlength=len(w.start) + 1)[: len(w.start)])
        number = passed - np.searchsorted(breaks, w.offsets[:-1])[w.doc]
        doc, h = w.doc, w.hash
        if wanted is not None:
            chosen = np.array([(d << 32) | n for d, ns in enumerate(wanted) for n in ns], np.int64)
            keep = np.isin((doc << 32) | number, chosen)
            doc, number, h = doc[keep], number[keep], h[keep]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        head = np.flatnonzero(new)
        self.doc, self.number = doc[head], number[head].astype(np.int32)
        line = np.cumsum(new) - 1
        size = np.diff(np.append(head, len(doc)))
        n = max(0, len(h) - SHINGLE + 1)
        grams = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(SHINGLE, np.uint64(0xD1342543DE82EF95))):
            grams += h[j : j + n] * p
        whole = line[:n] == line[SHINGLE - 1 : SHINGLE - 1 + n]
        short = np.flatnonzero(size < SHINGLE)
        part = np.flatnonzero((size < SHINGLE)[line]) if len(line) else np.zeros(0, int)
        table = powers(SHINGLE, np.uint64(0xA0761D6478BD642F))
        terms = h[part] * table[part - head[line[part]]] if len(part) else np.zeros(0, np.uint64)
        begins = np.cumsum(size[short]) - size[short]
        once = np.add.reduceat(terms, begins) + size[short].astype(np.uint64) if len(short) else np.zeros(0, np.uint64)
        self.line = np.concatenate((line[:n][whole], short))
        self.token = np.concatenate((mixed(grams[whole]), mixed(once)))


def rarity_classes(docs: DataFrame, split=Lines) -> np.ndarray:
    """Binary logarithm of the number of tokens per counter, over all documents. The size is fixed."""
    return _counted(docs, split)[0]


def _counted(docs: DataFrame, split) -> tuple[np.ndarray, int]:
    """Rarity classes, and the bytes of all texts, which one more slice counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memos()
        total, size = np.zeros(COUNTERS, np.int64), 0
        for _, texts in text_groups(batches):
            total += np.bincount((split(texts).token & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            size += sum(len(t) for t in texts if t)
        salt = TaskContext.get().partitionId() % SALTS
        parts = [planes(p) for p in (*np.split(total, SLICES), np.array([size], np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([salt] * (SLICES + 1), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(from_planes(c.as_py()) for c in table["counts"])
        return pa.table({"slice": table["slice"][:1], "salt": table["salt"][:1], "counts": pa.array([planes(total)], pa.binary())})

    schema = "slice int, salt int, counts binary"
    sums = docs.select("_key", F.col("text").cast("binary")).mapInArrow(count, schema)
    sums = sums.groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out, size = np.zeros((SLICES, COUNTERS // SLICES), np.int64), 0
    for r in sums.collect():  # as many rows as slices
        total = from_planes(r["counts"])
        if r["slice"] == SLICES:
            size = int(total[0])
        else:
            out[r["slice"]] = total
    return np.ceil(np.log2(out.ravel() + 1)).astype(np.uint8), size


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _by_line(line: np.ndarray, rank: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order by line, rank and token: by one number with the first bits of the token, which nearly always tell."""
    ahead = int(line.max(initial=0)).bit_length() + 8
    if ahead < 64:
        one = (line.astype(np.uint64) << np.uint64(64 - ahead + 8)) if ahead > 8 else np.zeros(len(line), np.uint64)
        one = one | (rank.astype(np.uint64) << np.uint64(64 - ahead)) | (token >> np.uint64(ahead))
        order = np.argsort(one)
        one, sorted_token = one[order], token[order]
        if not ((one[1:] == one[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any():
            return order
    return np.lexsort((token, rank, line))


def _prefixes(lines: Lines, rarity: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per prefix token: line, token, its place in the line's order; per line: distinct tokens, hash of the set."""
    rank = rarity[(lines.token & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = _by_line(lines.line, rank, lines.token)
    line, token = lines.line[order], lines.token[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
    line, token = line[new], token[new]
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, int)
    n = np.diff(np.append(head, len(line)))
    sets = mixed((np.add.reduceat(token, head) if len(head) else np.zeros(0, np.uint64)) + n.astype(np.uint64))
    place = np.arange(len(line)) - np.repeat(head, n)
    inside = place < np.repeat(prefix_length(n), n)
    return line[inside], token[inside], place[inside], n, sets


#: kind 0: a removed line; 1: candidate pair; 2: member of a token with more partners than were paired.
_FOUND = "kind int, _key long, line int, ref_key long, ref_line int, token long, n int, place int, more boolean"
_SENT = "block int, token binary, set binary, key binary, line binary, n binary, place binary, gone_key binary, gone_line binary"
_KINDS = (np.int64, np.int32, np.int32, np.int32)  # of key, line, n, place


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _first_of(sets: np.ndarray, key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (set, key, line) and the heads of equal sets in it."""
    order = np.lexsort((line, key, sets))
    s = sets[order]
    return order, np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)


def _send(held: list[tuple[np.ndarray, ...]], blocks: int, turn: int) -> Iterator[pa.RecordBatch]:
    """One task's lines: equal sets are sent once, the later of them are removed at once."""
    offsets = np.cumsum([0, *(len(x[3]) for x in held)])
    owner = np.concatenate([x[0] + o for x, o in zip(held, offsets)])
    token, place, sets, key, line, n = (np.concatenate([x[i] for x in held]) for i in range(1, 7))
    order, head = _first_of(sets, key, line)
    first = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    later = (key[order] != key[first]) | (line[order] != line[first])
    gone_key, gone_line = key[order[later]], line[order[later]]
    sent_line = np.zeros(len(sets), bool)
    sent_line[order[head]] = True
    keep = np.flatnonzero(sent_line[owner])
    sets, key, line, n = (x[owner] for x in (sets, key, line, n))
    block = (token[keep] % np.uint64(blocks)).astype(np.int32)
    keep = keep[np.argsort(block, kind="stable")]
    block = np.sort(block)
    edges = np.flatnonzero(np.concatenate(([True], np.diff(block) != 0, [True]))) if len(keep) else np.zeros(1, int)
    rows, short = [], [narrow(x) for x in (key, line, n, place)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        p = keep[lo:hi]
        rows.append((int(block[lo]), token[p].tobytes(), sets[p].tobytes(), *(planes(x[p]) for x in short), b"", b""))
    for lo in range(0, len(gone_key), 100_000):
        rows.append(((turn + lo // 100_000) % blocks, *[b""] * 6, planes(gone_key[lo : lo + 100_000]), planes(gone_line[lo : lo + 100_000])))
    types = [pa.int32(), *[pa.binary()] * 8]
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 64]), types)], names=_names(_SENT))


def _compatible(na: np.ndarray, pa_: np.ndarray, nb: int, pb: int) -> np.ndarray:
    """Length and positional filters for a first shared token at places ``pa_`` and ``pb``."""
    enough = (na * DENOMINATOR >= nb * NUMERATOR) & (nb * DENOMINATOR >= na * NUMERATOR)
    most = np.minimum(na - pa_, nb - pb)
    return enough & (most * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (na + nb))


def _first_fits(n: np.ndarray, place: np.ndarray, lo: int, b: int) -> list[int]:
    """The earliest compatible partners of ``b``, one more than are paired at once if there are as many."""
    fits: list[int] = []
    step = 64
    while lo < b and len(fits) <= FIRST_PARTNERS:
        hi = min(b, lo + step)
        fits.extend((lo + np.flatnonzero(_compatible(n[lo:hi], place[lo:hi], n[b], place[b]))).tolist())
        lo, step = hi, 2 * step
    return fits


def _shared(token: np.ndarray) -> np.ndarray:
    """Places of the tokens that are there more than once."""
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    return order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(token) else order


def _meet(table: pa.Table) -> pa.Table:
    cols = [table[c].to_pylist() for c in _names(_SENT)[1:]]
    token, sets = (np.frombuffer(b"".join(c), np.uint64) for c in cols[:2])
    key, line, n, place = (
        np.concatenate([from_planes(x, 8 * len(x) // len(t)) if t else np.zeros(0, k) for x, t in zip(c, cols[0])]).astype(k)
        for c, k in zip(cols[2:6], _KINDS)
    )
    gone_key, gone_line = (np.concatenate([from_planes(x, size) for x in c]) for c, size in zip(cols[6:], (8, 4)))
    met = _shared(token)  # a token of one line alone finds nothing
    token, sets, key, line, n, place = (x[met] for x in (token, sets, key, line, n, place))
    order = np.lexsort((line, key, sets, token))
    token, sets, key, line, n, place = (x[order] for x in (token, sets, key, line, n, place))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff(np.append(head, len(token))))
    copies = np.flatnonzero(~new & (place == 0) & ((key != key[first]) | (line != line[first])))
    out = [(0, np.concatenate((gone_key, key[copies])), np.concatenate((gone_line, line[copies])), None)]
    token, key, line, n, place = (x[head] for x in (token, key, line, n, place))
    order = np.lexsort((line, key, token))
    token, key, line, n, place = (x[order] for x in (token, key, line, n, place))
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True]))) if len(token) else np.zeros(1, int)
    later, earlier, crowd, crowd_more = [], [], [], []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2:
            continue
        more = []
        for b in range(lo + 1, hi):
            fit = _first_fits(n, place, lo, b)
            later.extend([b] * min(len(fit), FIRST_PARTNERS))
            earlier.extend(fit[:FIRST_PARTNERS])
            if len(fit) > FIRST_PARTNERS:
                more.append(b)
        if more:
            crowd.extend(range(lo, hi))
            flags = np.zeros(hi - lo, bool)
            flags[np.array(more) - lo] = True
            crowd_more.extend(flags.tolist())
    b, a, c = (np.array(x, np.int64) for x in (later, earlier, crowd))
    sizes = [len(out[0][1]), len(b), len(c)]
    return pa.table(
        {
            "kind": pa.array(np.repeat(np.array([0, 1, 2], np.int32), sizes)),
            "_key": np.concatenate((out[0][1], key[b], key[c])),
            "line": np.concatenate((out[0][2], line[b], line[c])),
            "ref_key": np.concatenate((np.zeros(sizes[0], np.int64), key[a], np.zeros(sizes[2], np.int64))),
            "ref_line": np.concatenate((np.zeros(sizes[0], np.int32), line[a], np.zeros(sizes[2], np.int32))),
            "token": np.concatenate((np.zeros(sizes[0] + sizes[1], np.int64), token[c].view(np.int64))),
            "n": np.concatenate((np.zeros(sizes[0] + sizes[1], np.int32), n[c])),
            "place": np.concatenate((np.zeros(sizes[0] + sizes[1], np.int32), place[c])),
            "more": np.concatenate((np.zeros(sizes[0] + sizes[1], bool), np.array(crowd_more, bool))),
        }
    )


def candidates(docs: DataFrame, block_bytes: int, held_entries: int, split=Lines) -> DataFrame:
    """Pairs, copies and crowds as ``_FOUND`` has them; ``split`` makes the lines of a group of texts."""
    classes, size = _counted(docs, split)
    blocks = max(1, -(-size // block_bytes))
    rarity = docs.sparkSession.sparkContext.broadcast(classes)  # one byte per counter

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memos()
        held, size, turn = [], 0, 7 * TaskContext.get().partitionId()
        for keys, texts in text_groups(batches):
            lines = split(texts)
            line, token, place, n, sets = _prefixes(lines, rarity.value)
            if not len(line):
                continue
            ids = np.asarray(keys.to_numpy(zero_copy_only=False), np.int64)[lines.doc]
            held.append((line, token, place.astype(np.int32), sets, ids, lines.number, n.astype(np.int32)))
            size += len(line)
            if size >= held_entries:
                yield from _send(held, blocks, turn)
                turn += 7
                held, size = [], 0
        if held:
            yield from _send(held, blocks, turn)

    sent = docs.select("_key", F.col("text").cast("binary")).mapInArrow(scatter, _SENT)
    return sent.groupBy("block").applyInArrow(_meet, _FOUND)


def mostly(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``chosen`` documents and few others, so that not all texts are shuffled for them."""
    return with_mark(docs, chosen, "_key").filter("_marked").select("_key", "text")


def token_sets(docs: DataFrame, chosen: DataFrame, split=Lines) -> DataFrame:
    """``_key, line, tokens`` of the ``chosen`` lines (``_key, line``), in one pass over the texts."""
    wanted = chosen.groupBy("_key").agg(F.collect_set("line").alias("lines"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, at = batch.column(2).to_pylist(), 0
            for keys, texts in text_groups([batch]):
                found = split(texts, chosen[at : at + len(texts)])
                at += len(texts)
                order = np.lexsort((found.token, found.line))
                line, token = found.line[order], found.token[order]
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
                line, token = line[new], token[new]
                offsets = np.searchsorted(line, np.arange(len(found.doc) + 1)).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.doc)), pa.array(found.number), tokens], names=["_key", "line", "tokens"])

    # a merge join at every size: what a small table shuffles tells what a large one will
    rows = docs.join(wanted.hint("merge"), "_key").dropDuplicates(["_key"]).select("_key", F.col("text").cast("binary"), "lines")
    return materialize(rows.mapInArrow(sets_of, "_key long, line int, tokens array<long>"))


def _sketches(line: np.ndarray, token: np.ndarray, lines: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of distinct tokens and sketch of each line.

    A sketch has about two bits per token, a power of two, 64 at least; a bit tells if the tokens that fall on it are odd in number.
    """
    order = _by_line(line, np.zeros(len(line), np.uint8), token)
    line, token = line[order], token[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
    line, token = line[new], token[new]
    n = np.bincount(line, minlength=lines)
    bits = np.left_shift(64, np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(bits)))
    at = start[line] + (token >> np.uint64(20)).astype(np.int64) % bits[line]
    odd = (np.bincount(at, minlength=int(start[-1])) & 1).astype(np.uint8)
    data, ends = np.packbits(odd, bitorder="little").tobytes(), (start // 8).tolist()
    return n, [data[lo:hi] for lo, hi in zip(ends, ends[1:])]


def sketches(docs: DataFrame, chosen: DataFrame, split=Lines) -> DataFrame:
    """``_key, line, n, sketch`` of the ``chosen`` lines (``_key, line``); no text is shuffled for them."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches):
            found = split(texts)
            n, sketch = _sketches(found.line, found.token, len(found.doc))
            arrays = [keys.take(pa.array(found.doc)), pa.array(found.number), pa.array(n.astype(np.int32)), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "line", "n", "sketch"])

    drawn = mostly(docs, chosen).select("_key", F.col("text").cast("binary")).mapInArrow(draw, "_key long, line int, n int, sketch binary")
    drawn = with_mark(drawn, chosen, "_key", "line").filter("_marked").drop("_marked")
    return materialize(drawn.dropDuplicates(["_key", "line"]))


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded until it is as short as the other."""
    x, y = sorted((x, y), key=len)
    short, long_, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        long_ = long_ >> bits ^ long_ & (1 << bits) - 1
    return (short ^ long_).bit_count()


def possible(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The ``pairs`` that their sketches do not rule out; no similar pair is lost.

    Every bit in which two sketches differ is due to a token of one line alone. So sets of ``a`` and ``b`` tokens whose
    sketches differ in ``d`` bits share at most half of ``a + b - d``.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = (batch.column(c).to_pylist() for c in ("both", "sketch", "ref_sketch"))
            keep = [(a - _differ(*two)) * (NUMERATOR + DENOMINATOR) >= 2 * NUMERATOR * a for a, *two in zip(n, x, y)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    names = ["_key", "line", "ref_key", "ref_line"]
    refs = drawn.select(F.col("_key").alias("ref_key"), F.col("line").alias("ref_line"), F.col("n").alias("ref_n"), F.col("sketch").alias("ref_sketch"))
    # merge joins at every size, as in token_sets
    met = drawn.join(pairs.hint("merge"), ["_key", "line"]).join(refs.hint("merge"), ["ref_key", "ref_line"])
    met = met.select(*names, (F.col("n") + F.col("ref_n")).alias("both"), "sketch", "ref_sketch")
    return materialize(met.mapInArrow(fit, "_key long, line int, ref_key long, ref_line int"))


def similar(pairs: DataFrame, drawn: DataFrame, docs: DataFrame, split=Lines) -> DataFrame:
    """The ``pairs`` whose whole token sets are similar enough; ``drawn`` has the sketches of their lines.

    Sets are made of the pairs that sketches leave, as chance candidates grow faster than the documents.
    """
    pairs = possible(materialize(pairs.distinct()), drawn)
    ends = pairs.select(F.col("ref_key").alias("_key"), F.col("ref_line").alias("line"))
    chosen = pairs.select("_key", "line").unionByName(ends)
    sets = token_sets(mostly(docs, chosen), chosen, split)
    mine = with_mark(sets, pairs, "_key", "line").filter("_marked").drop("_marked")
    refs = with_mark(sets, ends, "_key", "line").filter("_marked")
    refs = refs.select(F.col("_key").alias("ref_key"), F.col("line").alias("ref_line"), F.col("tokens").alias("ref_tokens"))
    both = mine.join(pairs.hint("merge"), ["_key", "line"]).join(refs.hint("merge"), ["ref_key", "ref_line"])
    shared = F.size(F.array_intersect("tokens", "ref_tokens"))
    enough = shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.size("tokens") + F.size("ref_tokens"))
    return both.filter(enough).select("_key", "line", "ref_key", "ref_line")


def earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}._key") < F.col(f"{b}._key")) | (
        (F.col(f"{a}._key") == F.col(f"{b}._key")) & (F.col(f"{a}.line") < F.col(f"{b}.line"))
    )


def removed_lines(docs: DataFrame, block_bytes: int = BLOCK_BYTES, held_entries: int = HELD_ENTRIES) -> DataFrame:
    """``_key, line`` of every line with an earlier line of similarity 4/5 or more.

    ``docs`` holds ``_key`` (a number) and ``text``; earlier means a smaller key, or higher up in the same text.
    """
    found = materialize(candidates(docs, block_bytes, held_entries))
    pairs = materialize(found.filter("kind = 1").select("_key", "line", "ref_key", "ref_line").distinct())
    crowd = found.filter("kind = 2").select("token", "_key", "line", "n", "place", "more")
    ends = pairs.select("_key", "line").unionByName(pairs.select(F.col("ref_key").alias("_key"), F.col("ref_line").alias("line")))
    chosen = ends.unionByName(crowd.select("_key", "line"))
    drawn = sketches(docs, chosen)
    copies = found.filter("kind = 0").select("_key", "line")
    removed = materialize(copies.unionByName(similar(pairs, drawn, docs).select("_key", "line")).distinct())
    open_ = materialize(crowd.filter("more").join(removed, ["_key", "line"], "left_anti"))
    if not open_.isEmpty():
        a, b = F.col("a.n"), F.col("b.n")
        most = F.least(a - F.col("a.place"), b - F.col("b.place"))
        fits = (
            earlier("a", "b")
            & (a * DENOMINATOR >= b * NUMERATOR)
            & (b * DENOMINATOR >= a * NUMERATOR)
            & (most * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (a + b))
        )
        rest = open_.alias("b").join(crowd.alias("a"), (F.col("a.token") == F.col("b.token")) & fits)
        rest = rest.select("b._key", "b.line", F.col("a._key").alias("ref_key"), F.col("a.line").alias("ref_line"))
        removed = removed.unionByName(similar(rest, drawn, docs).select("_key", "line"))
    return removed.distinct()


def _with_lines(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows with ``lines``, the places that go, or null.

    A bitmap of fixed size tells nearly all rows that keep everything; only the others are shuffled.
    """
    gone = materialize(removed.groupBy("_key").agg(F.collect_set("line").alias("lines")))
    marked = with_mark(rows, gone, "_key")
    kept = marked.filter("not _marked").select(*rows.columns, F.lit(None).cast("array<int>").alias("lines"))
    return kept.unionByName(marked.filter("_marked").select(*rows.columns).join(gone.hint("merge"), "_key", "left"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n_lines, n_removed, kept`` for every row: the text without lines that match an earlier one.

    ``n_lines`` counts lines with words; lines without are neither counted nor removed. Matches are judged
    on the input, not on what is left. A null text stays null with no lines. A null key counts as the
    smallest; different texts under one key, or without one, are different documents, in a fixed order, and
    equal ones the same. No rows give no rows.
    """
    rows = identified(docs.select(key, text), key, text)
    source = rows.select(F.col("_doc").getField(key).alias("_id"), "_key", F.col("_doc").getField(text).alias("text"))
    joined = _with_lines(source, removed_lines(source.select("_key", "text"), **options))
    lines = F.split("text", "\n", -1)
    drop = F.coalesce(F.col("lines"), F.array().cast("array<int>"))
    kept = F.when(
        F.size(drop) > 0, F.array_join(_without(lines, drop), "\n")
    ).otherwise(F.col("text"))
    # from the first character of a word to the end of its line
    n_lines = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D][^\\n]*"))
    return joined.select(
        F.col("_id").alias(key),
        F.greatest(F.coalesce(n_lines, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_removed"),
        kept.alias("kept"),
    )


def _without(lines: Column, drop: Column) -> Column:
    """Lines whose place is not in ``drop``: both sorted once, then cut between dropped places."""
    bounds = F.sort_array(drop)
    starts = F.concat(F.array(F.lit(0)), F.transform(bounds, lambda i: i + 1))
    ends = F.concat(bounds, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, F.greatest(e - s, F.lit(0)))))


def digest(deduped: DataFrame, kept: str = "kept") -> DataFrame:
    """The same rows with the kept text as a SHA-256 (null as empty)."""
    return deduped.withColumn("kept_sha256", F.sha2(F.coalesce(F.col(kept), F.lit("")), 256)).drop(kept)


def replace_text(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """``docs``, all rows and columns, with the deduped text (and its ``length``, if there is such a column)."""
    rows = identified(docs, key, text)
    source = rows.select("_key", F.col("_doc").getField(text).alias("text"))
    rows = _with_lines(rows, removed_lines(source, **options))
    text_now = F.col(f"_doc.{text}")
    kept = F.when(F.size("lines") > 0, F.array_join(_without(F.split(text_now, "\n", -1), F.col("lines")), "\n")).otherwise(text_now)
    rows = rows.withColumn("_kept", kept)
    out = {text: F.col("_kept")}
    if length in docs.columns:
        out[length] = F.char_length("_kept").cast(docs.schema[length].dataType)
    return rows.select(*[out.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
