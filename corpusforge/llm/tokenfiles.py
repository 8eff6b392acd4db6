"""Token ids as files with keyed access.

Documents are dealt to shards as ranges of their key. A shard is two files: the raw ids of its documents
end to end, and an index. The index holds a minimal perfect hash of the shard's keys (levels of bit arrays:
a key that shares its bit with another goes on to the next level), one slot per key with a stored
fingerprint and the key's first document, and per document its key and where its ids start. So a key is
found by about two bits, one slot and one offset, whatever the size of the shard.

Files are written by the tasks through pyarrow's file systems, to any folder those know (file, hdfs, s3,
gs, abfs). A task that runs again writes files of another name; only files named by the manifest, a table
that Spark commits, count.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import MIN_LONG, key_column, mixed, text_bytes, text_groups
from corpusforge.llm.tokens import encoder

END_ID = 2
#: Text in a shard, ids read at once, and bits per key and level of the hash.
SHARD_BYTES, READ_IDS, SPREAD = 32 << 20, 2 << 20, 2
_HEAD = struct.Struct("<8sBQQQQ")  # magic, id width, null keys, documents, keys, levels
_MAGIC = b"idshard1"
_SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("many", "<u4")])
MANIFEST = "shard int, file string, documents long, ids long, null_keys long, first_key long, last_key long"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; any number, or -1, for another key."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.begin = np.concatenate(([0], np.cumsum(sizes))).tolist()
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], [np.zeros(0, bool)]
        while len(keys):
            size = -(-SPREAD * len(keys) // 64) * 64
            bits = cls._bits(keys, len(sizes), size)
            taken = np.bincount(bits, minlength=size) == 1
            levels.append(taken)
            sizes.append(size)
            keys = keys[~taken[bits]]
        return cls(sizes, np.packbits(np.concatenate(levels), bitorder="little").view("<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.begin[level] + self._bits(keys[open_], level, size)
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> inside & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word[hit] & ((np.uint64(1) << inside[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[bit[hit] >> 6] + lower
            open_ = open_[~hit]
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype("<u4")


class Index:
    """Index of one shard: keys in ascending order (null ones first), starts of their ids, and the hash of the keys."""

    def __init__(self, keys: np.ndarray, nulls: int, starts: np.ndarray, width: int, table: PerfectHash, slots: np.ndarray):
        self.keys, self.nulls, self.starts, self.width, self.table, self.slots = keys, nulls, starts, width, table, slots

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> Index:
        known = keys[nulls:]
        head = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1]))) if len(known) else np.zeros(0, np.int64)
        table = PerfectHash.build(known[head])
        slots = np.zeros(len(head), _SLOT)
        at = table.find(known[head])
        slots["print"][at], slots["first"][at] = _prints(known[head]), head + nulls
        slots["many"][at] = np.diff(np.append(head, len(known)))
        return cls(keys, nulls, np.concatenate(([0], np.cumsum(lengths))).astype("<i8"), width, table, slots)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; no documents if the fingerprint differs."""
        at = self.table.find(keys)
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.slots[at]
        same = (at >= 0) & (slot["print"] == _prints(keys))
        return slot["first"].astype(np.int64), np.where(same, slot["many"], 0).astype(np.int64)

    def dump(self) -> bytes:
        head = _HEAD.pack(_MAGIC, self.width, self.nulls, len(self.keys), len(self.slots), len(self.table.sizes))
        return b"".join((head, np.array(self.table.sizes, "<i8").tobytes(), self.table.words.tobytes(), self.slots.tobytes(), self.keys.astype("<i8").tobytes(), self.starts.tobytes()))

    @classmethod
    def load(cls, data: bytes) -> Index:
        magic, width, nulls, documents, keys, levels = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an index of a token shard")
        stream = io.BytesIO(data)
        stream.seek(_HEAD.size)
        take = lambda kind, n: np.frombuffer(stream.read(np.dtype(kind).itemsize * n), kind)
        sizes = take("<i8", levels).tolist()
        table = PerfectHash(sizes, take("<u8", sum(sizes) // 64))
        slots = take(_SLOT, keys)
        return cls(take("<i8", documents), nulls, take("<i8", documents + 1), width, table, slots)


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary_name: str = "word_bpe_49k.json",
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the ids of every document, each closed by ``end_id``, to ``folder``; return its manifest.

    Documents stand in ascending key order, null keys first, equal keys in the order of a hash of the text.
    A null text counts as empty and still has its closing id; repeated rows are written as often as they
    occur, in any number of neighbouring shards; further columns do not matter; no rows give no shards.
    Ids take two bytes where the vocabulary allows it, else four, little-endian.
    """
    spark = docs.sparkSession
    shards = max(1, -(-text_bytes(docs, text) // shard_bytes))
    body = F.col(text).cast("binary")
    order = ["_null", "_key", "_hash", "_salt"]
    rows = docs.select(
        F.col(key).isNotNull().alias("_null"), key_column(key).alias("_key"), F.xxhash64(text).alias("_hash"),
        F.monotonically_increasing_id().alias("_salt"), body.alias("_text"),
    )
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary_name)
        width = 2 if max(tokens.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        close = np.array([end_id], "<u4").tobytes()
        store, path = file_system(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        keys, lengths, nulls, out = [], [], 0, None
        for batch in batches:
            nulls += batch.num_rows - batch.column(0).true_count
            for ks, texts in text_groups([batch.select([1, 2])]):
                out = out or store.open_output_stream(f"{path}/{name}.ids")
                ids = tokens.ids([t or b"" for t in texts])
                keys.append(ks.to_numpy())
                lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1)
                for at in range(0, len(ids), 1_000):
                    joined = np.frombuffer(close.join([*ids[at : at + 1_000], b""]), "<u4")
                    out.write(joined.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        keys, lengths = np.concatenate(keys), np.concatenate(lengths)
        with store.open_output_stream(f"{path}/{name}.index") as f:
            f.write(Index.build(keys, nulls, lengths, width).dump())
        known = keys[nulls:]
        ends = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        row = (TaskContext.get().partitionId(), name, len(keys), int(lengths.sum()), nulls, *ends)
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    written = ranged.select(F.col("_null"), "_key", "_text").mapInArrow(write, MANIFEST)
    # a row per shard: one file, as each file that an executor commits costs it some processes of the file system's shell
    written.repartition(1).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in order, with ``before``, the number of ids in earlier shards."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def _open(folder: str, name: str) -> tuple[Index, pa.NativeFile]:
    store, path = file_system(folder)
    with store.open_input_stream(f"{path}/{name}.index") as f:
        index = Index.load(f.read())
    return index, store.open_input_file(f"{path}/{name}.ids")


def _ids(index: Index, ids: pa.NativeFile, first: int, end: int) -> np.ndarray:
    """Ids ``first`` to ``end`` of a shard, as four-byte numbers."""
    data = ids.read_at((end - first) * index.width, first * index.width)
    return np.frombuffer(data, f"<u{index.width}").astype("<u4", copy=False)


def _checksums(index: Index, ids: pa.NativeFile, documents: np.ndarray, read_ids: int) -> Iterator[int]:
    """CRC-32 of the ids of ascending ``documents``, reading a bounded number of ids at once."""
    starts, ends = index.starts[documents], index.starts[documents + 1]
    at = 0
    while at < len(documents):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + read_ids, "right")))
        lo, hi = int(starts[at]), int(ends[upto - 1])
        if hi - lo <= read_ids:
            data = memoryview(_ids(index, ids, lo, hi)).cast("B")
            for a, b in zip(((starts[at:upto] - lo) * 4).tolist(), ((ends[at:upto] - lo) * 4).tolist()):
                yield zlib.crc32(data[a:b])
        else:
            crc = 0
            for a in range(lo, hi, read_ids):
                crc = zlib.crc32(_ids(index, ids, a, min(hi, a + read_ids)), crc)
            yield crc
        at = upto


def read_documents(spark: SparkSession, folder: str, key: str = "doc_id", read_ids: int = READ_IDS) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, read from the files by way of their index.

    ``start`` counts the ids of all documents before it, ``n_tokens`` includes the closing id, and the
    CRC-32 is that of the ids as little-endian unsigned 32-bit numbers.
    """
    shards = read_manifest(spark, folder).select("file", "before")
    n = max(1, shards.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, ids = _open(folder, name)
                with ids:
                    first, many = index.find(index.keys[index.nulls :])
                    known = index.keys[index.nulls :]
                    heads = np.concatenate(([True], known[1:] != known[:-1])) if len(known) else np.zeros(0, bool)
                    step = np.arange(len(known)) - np.repeat(np.flatnonzero(heads), np.diff(np.append(np.flatnonzero(heads), len(known))))
                    if (step >= many).any() or (index.keys[first + step] != known).any():
                        raise ValueError(f"the index of {name} does not find its own keys")
                    documents = np.concatenate((np.arange(index.nulls), first + step))
                    crcs = np.fromiter(_checksums(index, ids, documents, read_ids), np.int64, len(documents))
                for lo in range(0, len(documents), 50_000):
                    some = documents[lo : lo + 50_000]
                    null = np.arange(lo, lo + len(some)) < index.nulls
                    starts, sizes = index.starts[some], index.starts[some + 1] - index.starts[some]
                    columns = [pa.array(index.keys[some], mask=null), pa.array(starts + before), pa.array(sizes), pa.array(crcs[lo : lo + 50_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])

    found = shards.repartition(n, "file").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("key", key)


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids`` (binary) of the documents of ``keys``, by the index alone.

    A key without documents, or null, has no row; a repeated key has its documents as often. A task reads
    the index of a shard once for all of its keys. The driver holds two keys per shard.
    """
    spark = keys.sparkSession
    shards = read_manifest(spark, folder).filter(F.col("first_key").isNotNull()).orderBy("shard").collect()  # one row per shard
    firsts, lasts = (np.array([s[c] for s in shards], np.int64) for c in ("first_key", "last_key"))
    shared = spark.sparkContext.broadcast((firsts, lasts, [s["file"] for s in shards], [s["before"] for s in shards]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = np.searchsorted(shared.value[1], wanted, "left")
            n = np.maximum(np.searchsorted(shared.value[0], wanted, "right") - lo, 0)
            shard = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(wanted, n)), pa.array(shard.astype(np.int32))], names=["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, ids = None, None, None
        for batch in batches:
            wanted, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(shard).tolist():
                if s != at:
                    at, (index, ids) = s, _open(folder, shared.value[2][s])
                mine = wanted[shard == s]
                for k, first, many in zip(mine.tolist(), *(x.tolist() for x in index.find(mine))):
                    for d in range(first, first + many):
                        if index.keys[d] != k:
                            continue
                        lo, hi = int(index.starts[d]), int(index.starts[d + 1])
                        row = (k, lo + shared.value[3][s], hi - lo, _ids(index, ids, lo, hi).tobytes())
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["key", "start", "n_tokens", "ids"])

    dealt = keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).mapInArrow(deal, "key long, shard int")
    dealt = dealt.repartition("shard", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("shard")
    return dealt.mapInArrow(read, "key long, start long, n_tokens long, ids binary").withColumnRenamed("key", key)
