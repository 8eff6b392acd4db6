"""Phrases of words that occur together, mined from a sample and counted exactly.

A sample proposes: phrases that reach a lowered count in it. Its negative border are the phrases not
proposed whose two parts, without the first and without the last word, are. One pass over all documents
counts proposals and border exactly. A phrase of the border that turns out frequent is a failure: phrases
built on it were never counted. A further pass counts those, until a pass finds nothing that its own
filters did not know; then every frequent phrase has been counted over every document. A further pass
takes the phrases that it counts for the first time as frequent until it knows better, so one is enough.

Tasks know proposals and frequent phrases as bitmaps of bounded size. A bit set by another phrase makes
a task count more than it must, and it is the same in every task, so counts stay exact. Phrases are
counted as words, not as hashes: a task numbers its words and adds up before anything is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import mixed, text_groups
from corpusforge.session import materialize

UNKNOWN = "und"
MIN_COUNT, LONGEST = 10, 3
#: Part of the documents that proposes phrases, and the part of the expected count that a proposal needs.
SAMPLE, LOWERED = 0.25, 0.8
#: Texts counted together in a task; most bits of a bitmap (32 MB), and bits per phrase below that.
HELD_BYTES = 6 << 20
MOST_BITS, BITS_EACH = 1 << 28, 16
SLICE_BYTES = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_STEP = np.uint64(0xD1342543DE82EF95)


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _phrase_hashes(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of it without its last and without its first word."""
    return mixed(first * _STEP + rest)


def phrase_hash(words: list[bytes], lang: str) -> int:
    level = _word_hashes(words, lang)
    while len(level) > 1:
        level = _phrase_hashes(level[:-1], level[1:])
    return int(level[0])


class Bitmap:
    """A set of hashes; what it does not hold was never added."""

    def __init__(self, data: np.ndarray):
        self.data, self.mask = data, np.uint64(8 * len(data) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(phrases: DataFrame) -> Bitmap:
    """Bitmap of ``lang, phrase``; its size follows the number of phrases up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(8 * SLICE_BYTES, 1 << (BITS_EACH * phrases.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = np.array([phrase_hash(t.encode().split(b" "), g) for g, t in zip(langs, texts)], np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        slices = mine.reshape(-1, SLICE_BYTES)
        salt = TaskContext.get().partitionId() % 64
        for i in np.flatnonzero(slices.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([slices[i].tobytes()], pa.binary())], names=["slice", "salt", "bits"])

    def either(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE_BYTES, np.uint8)
        for part in table["bits"]:
            total |= np.frombuffer(part.as_py(), np.uint8)
        return pa.table({"slice": table["slice"][:1], "salt": table["salt"][:1], "bits": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, salt int, bits binary"
    marked = phrases.select("lang", "phrase").mapInArrow(mark, schema).groupBy("slice", "salt").applyInArrow(either, schema)
    whole = np.zeros((bits // 8 // SLICE_BYTES, SLICE_BYTES), np.uint8)
    for r in marked.groupBy("slice").applyInArrow(either, schema).collect():  # the bitmap, whose size is bounded
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(whole.ravel())


class _Texts:
    """Words of some texts of one language: numbers in order of appearance, and which are followed in their piece."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        cut = _BREAK[data]
        inside = ~(cut | _SPACE[data])
        start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        end = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        packed = np.ascontiguousarray(data[inside])
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        found = found.dictionary_encode()
        self.words, self.number = found.dictionary, found.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(cut)[start] if len(start) else np.zeros(0, np.int64)
        self.followed = piece[:-1] == piece[1:]


def count_in(texts: list[bytes], lang: str, rounds: list[list[Bitmap | None]], longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and their counts in ``texts``, in this round: those that no earlier round counted.

    A round is a bitmap per phrase length below ``longest``; None holds everything. A round counts a
    phrase when it holds the phrase without its last and without its first word. The first round counts
    all words, and the empty phrase for their total. Later rounds hold what they are the first to count.
    """
    t = _Texts(texts)
    if not len(t.number):
        return
    if len(rounds) == 1:
        yield pa.array([b""], pa.large_binary()), np.array([len(t.number)])
        yield t.words, np.bincount(t.number, minlength=len(t.words))
    if longest == 1:
        return
    names, number, place = t.words, t.number, np.arange(len(t.number))
    hashes = _word_hashes(names.to_pylist(), lang)
    held = [np.ones(len(names), bool) if r[0] is None else r[0].holds(hashes) for r in rounds]
    followed = t.followed
    for length in range(2, longest + 1):
        # both parts of a phrase are neighbours among the shorter ones: places p and p + 1
        pair = np.flatnonzero((place[1:] == place[:-1] + 1) & followed[place[:-1] + length - 2]) if len(place) else place
        now = held[-1][number]
        pair = pair[now[pair] & now[pair + 1]]
        first, last = number[pair], number[pair + 1]
        keys, back, counts = np.unique(first * len(names) + last, return_inverse=True, return_counts=True)
        first, last = keys // len(names), keys % len(names)
        parts = [h[first] & h[last] for h in held]
        fresh = np.flatnonzero(~np.logical_or.reduce(parts[:-1])) if len(parts) > 1 else np.arange(len(keys))
        tail = t.words.take(pa.array(t.number[place[pair] + length - 1][_first_of(back, len(keys))]))
        longer = pc.binary_join_element_wise(names.take(pa.array(first)), tail, pa.scalar(b" ", pa.large_binary()))
        yield longer.take(pa.array(fresh)), counts[fresh]
        if length == longest:
            return
        hashes = _phrase_hashes(hashes[first], hashes[last])
        seen, held = np.zeros(len(keys), bool), []
        for p, r in zip(parts, rounds):
            known = np.ones(len(keys), bool) if r[length - 1] is None else r[length - 1].holds(hashes)
            held.append(p & (known | ~seen) if held else p & known)
            seen |= p
        names, number, place = longer, back.astype(np.int64), place[pair]


def _first_of(back: np.ndarray, n: int) -> np.ndarray:
    """For every unique value the first place where it stands."""
    out = np.zeros(n, np.int64)
    out[back[::-1]] = np.arange(len(back))[::-1]
    return out


def counted(docs: DataFrame, rounds: list[list[Bitmap | None]], longest: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``lang, words, phrase, f`` of this round, over all ``docs`` (``lang``, ``text``); words 0 is the total."""
    shared = docs.sparkSession.sparkContext.broadcast(rounds)  # bitmaps of bounded size

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                tag = pa.scalar(lang.encode(), pa.large_binary())
                for phrases, counts in count_in(texts, lang, shared.value, longest):
                    keys = pc.binary_join_element_wise(phrases, tag, pa.scalar(b"\t", pa.large_binary()))
                    for lo in range(0, len(keys), 100_000):
                        part = keys.slice(lo, 100_000).cast(pa.large_string()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([part, pa.array(counts[lo : lo + 100_000], pa.int64())], names=["key", "n"])

        for langs, texts in text_groups(batches, min(held_bytes, 2 << 20)):
            for lang, text in zip(langs.to_pylist(), texts):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size >= held_bytes:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    source = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary"))
    # tasks have added up already: adding up again before the shuffle costs more than it saves
    sums = source.mapInArrow(tally, "key string, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("f"))
    # a word holds no tab and no space, so the first tab ends the phrase
    at = F.locate("\t", F.col("key"))
    phrase = F.substr("key", F.lit(1), at - 1)
    n_words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    return sums.select(F.substr("key", at + 1).alias("lang"), n_words.cast("int").alias("words"), phrase.alias("phrase"), "f")


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sample: float = SAMPLE, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """``lang, words, phrase, f`` of every phrase of up to ``longest`` words found ``min_count`` times or more.

    ``docs`` has ``lang`` and ``text``. A row of 0 words holds the number of all words of its language.
    """
    lowered = max(1, int(LOWERED * min_count * sample))
    proposed = counted(docs.sample(False, sample, 7), [[None] * longest], longest - 1, held_bytes) if longest > 1 else None
    rounds: list[list[Bitmap | None]] = []
    if proposed is not None:
        proposed = materialize(proposed.filter((F.col("words") > 0) & (F.col("f") >= lowered)))
        rounds = [[bitmap(proposed.filter(F.col("words") == n)) for n in range(1, longest)]]
    found: list[DataFrame] = []
    while True:
        here = counted(docs, rounds or [[]], longest, held_bytes)
        found.append(materialize(here.filter((F.col("words") == 0) | (F.col("f") >= min_count))))
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
        if longest == 1 or len(rounds) > 1 or not _unknown(found[-1], rounds, longest):
            return known
        rounds.append([bitmap(known.filter(F.col("words") == n)) for n in range(1, longest)])


def _unknown(found: DataFrame, rounds: list[list[Bitmap]], longest: int) -> bool:
    """Whether a frequent phrase of the last pass, short enough to be part of another, was not held by its filters."""
    last = found.sparkSession.sparkContext.broadcast(rounds[-1])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                parts = phrase.encode().split(b" ")
                if not last.value[len(parts) - 1].holds(np.array([phrase_hash(parts, lang)], np.uint64))[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["one"])
                    return

    short = found.filter((F.col("words") > 0) & (F.col("words") < longest)).select("lang", "phrase")
    return not short.mapInArrow(missing, "one int").isEmpty()


def _parts(phrase: str, words: Column, k: Column) -> tuple[Column, Column]:
    cut = F.split(phrase, " ")
    return F.array_join(F.slice(cut, F.lit(1), k), " "), F.array_join(F.slice(cut, k + 1, words - k), " ")


def collocations(
    docs: DataFrame,
    top: int = 2000,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    covered_percent: int = 50,
    lang: str = "lang",
    text: str = "text",
    sample: float = SAMPLE,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase found ``a`` times is scored by its weakest cut into parts found ``l`` and ``r`` times:
    floor(1000000 a a / (l r)), ties to the shorter first part. A phrase inside a longer frequent one that
    covers ``covered_percent`` of it goes. Order: score and ``a`` descending, then the phrase's bytes.

    A null language is ``und``; null and blank texts have no words; repeated rows count as often as they
    occur; keys and further columns do not matter; no rows give no rows. The result does not depend on the
    sample, on partitioning or on ``held_bytes``.
    """
    known = frequent_phrases(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), min_count, longest, sample, held_bytes)
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    counts = known.filter(F.col("words") > 0).filter(F.col("words") < longest).select("lang", "phrase", "f")
    found = known.filter("words > 1")
    cuts = found.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = _parts("phrase", F.col("words"), F.col("k"))
    cuts = cuts.withColumns({"left": left, "right": right})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # counts up to 10^14: the products fit in 38 digits
    a, l, r = (F.col(c).cast("decimal(14,0)") for c in "alr")
    scaled = F.lit(1_000_000).cast("decimal(7,0)") * (a * a)
    cuts = cuts.withColumns({"_p": scaled, "_q": l * r}).withColumn("score", F.expr("_p div _q"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("_c")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(lowest)
    inner = found.filter("words > 2").select("lang", F.col("f"), F.explode(_inner_phrases("phrase", "words")).alias("phrase"))
    covering = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    scored = scored.join(covering, ["lang", "phrase"], "left")
    scored = scored.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered_percent * F.col("a")))
    scored = scored.select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.col("_c.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inner_phrases(phrase: str, words: str) -> Column:
    """All shorter phrases of two words or more inside a phrase."""
    cut = F.split(phrase, " ")
    sizes = F.sequence(F.lit(2), F.col(words) - 1)
    runs = F.transform(
        sizes, lambda s: F.transform(F.sequence(F.lit(1), F.col(words) - s + 1), lambda i: F.array_join(F.slice(cut, i, s), " "))
    )
    return F.array_distinct(F.flatten(runs))
