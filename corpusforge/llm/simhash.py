"""SimHash near-duplicates: exact pairs within a Hamming radius, through a vantage-point tree.

Texts become 64-bit fingerprints, equal fingerprints one point. A tree of vantage points, fitted on a
bounded sample, sends every point to one home shard: inside or outside a vantage point's radius. A point
whose ball crosses the boundary also visits the other side, so by the triangle inequality every pair
within the radius meets in a shard, and no other branch need be searched. Shards compare their points in
blocks and return a spanning forest, never all pairs; the forests are joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import identified, text_groups, with_mark
from corpusforge.session import materialize

#: Points the tree is fitted on at most (about), points a shard should have, and most rows of one task.
SAMPLE, SHARD_POINTS, TASK_ROWS = 40_000, 3_000, 60_000
_CELLS = 1 << 21


# --- fingerprints ----------------------------------------------------------------------------------------


def simhash(text: bytes, shingle_words: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """Bit b is set if it is set in more than half of the shingles' XXH64; no words give 0."""
    words = text.lower().split()  # of bytes: A-Z and the six white space characters only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    hashed, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle_words + 1
    for lo in range(0, n, chunk):
        hi = min(n, lo + chunk)
        shingles = map(b" ".join, zip(*(words[lo + j : hi + j] for j in range(shingle_words))))
        h = np.fromiter((hashed(s, seed) for s in shingles), "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_set(text: bytes, shingle_words: int, seed: int = 43) -> int:
    """Hash of the set of shingles that :func:`simhash` takes."""
    words = text.lower().split()
    shingles = set(map(b" ".join, zip(*(words[j:] for j in range(shingle_words))))) or {b" ".join(words)}
    return sum(xxhash.xxh64_intdigest(s, seed) for s in shingles) & ((1 << 64) - 1)


def fingerprints(docs: DataFrame, shingle_words: int = 3, with_sets: bool = False) -> DataFrame:
    """``_id, _key, fp`` for every row of ``_id, _key, text``; ``fp`` is the fingerprint's bits as a signed number.

    A null text counts as empty. ``with_sets`` adds ``shingles``, a hash of the set of shingles.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches):
            bits = np.array([simhash(t or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            arrays = [keys, pa.array(bits)]
            if with_sets:
                sets = np.array([shingle_set(t or b"", shingle_words) for t in texts], np.uint64)
                arrays.append(pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["row", "fp", "shingles"][: 3 if with_sets else 2]
    source = docs.select(F.struct("_id", "_key").alias("row"), F.col("text").cast("binary"))
    schema = f"row {source.schema[0].dataType.simpleString()}, fp long" + (", shingles long" if with_sets else "")
    return source.mapInArrow(compute, schema).select("row.*", *names[1:])


# --- the tree --------------------------------------------------------------------------------------------


class VantageTree:
    """Nodes (point, radius, inside, outside); a child below 0 is shard ``-1 - child``."""

    def __init__(self, sample: np.ndarray, scale: float, reach: int, shard_points: int = SHARD_POINTS):
        self.reach, self.nodes, self.shards = reach, [], 0
        self.root = self._grow(sample, scale, shard_points, np.random.default_rng(7))

    def _grow(self, points: np.ndarray, scale: float, most: int, random: np.random.Generator) -> int:
        split = self._split(points, random) if len(points) * scale > most and len(points) >= 8 else None
        if split is None:
            self.shards += 1
            return -self.shards
        vantage, radius = split
        inside = np.bitwise_count(points ^ vantage) <= radius
        at = len(self.nodes)
        self.nodes.append(None)
        left = self._grow(points[inside], scale, most, random)
        right = self._grow(points[~inside], scale, most, random)
        self.nodes[at] = (vantage, radius, left, right)
        return at

    def _split(self, points: np.ndarray, random: np.random.Generator) -> tuple[np.uint64, int] | None:
        """Of some vantage points and all radii, the split that leaves the largest side smallest, visitors included."""
        best, found = 0.95, None
        for vantage in random.choice(points, min(len(points), 12), replace=False):
            upto = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65)) / len(points)
            for radius in range(64):
                crossing = upto[radius] - (upto[radius - self.reach] if radius >= self.reach else 0.0)
                cost = max(upto[radius], 1 - upto[radius] + crossing)
                if cost < best:
                    best, found = cost, (vantage, radius)
        return found

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, is home) for every shard a point belongs to or visits."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -1 - node, np.int32), home))
                continue
            vantage, radius, left, right = self.nodes[node]
            far = np.bitwise_count(points[at] ^ vantage).astype(np.int16)
            inside = far <= radius
            # a visitor follows its ball to both sides; of two homes apart, the inner one visits
            go_left = np.where(home, inside, far - self.reach <= radius)
            go_right = np.where(home, ~inside | (far + self.reach > radius), far + self.reach > radius)
            todo.append((left, at[go_left], home[go_left]))
            todo.append((right, at[go_right], (home & ~inside)[go_right]))
        if not out:
            return np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give joined places the smaller of their labels, until nothing changes; labels are places."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short


def _close(fp: np.ndarray, homes: np.ndarray, right: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (home, other) of all pairs within ``reach``, some of them more than once.

    Prints that differ in ``reach`` bits at most agree in one of ``reach + 1`` runs of bits, so only those that do
    are compared; if they are more than all pairs, all are.
    """
    cuts = np.linspace(0, 64, reach + 2).astype(int) if reach < 64 else np.array([0, 64])
    sorted_, total = [], 0
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        run = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = right[np.argsort(run[right], kind="stable")]
        first = np.searchsorted(run[order], run[homes], "left")
        n = np.searchsorted(run[order], run[homes], "right") - first
        sorted_.append((order, first, n))
        total += int(n.sum())
    if reach >= 64 or total >= len(homes) * len(right):
        step = max(1, _CELLS // max(1, len(right)))
        for lo in range(0, len(homes), step):
            rows = homes[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= reach)
            yield rows[i], right[j]
        return
    for order, first, n in sorted_:
        ends, lo = np.cumsum(n), 0
        while lo < len(homes):  # a bounded number of pairs at once, those of one home at least
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + _CELLS, "right")))
            i = np.repeat(homes[lo:hi], n[lo:hi])
            j = order[np.arange(len(i)) + done - np.repeat(ends[lo:hi] - n[lo:hi] - first[lo:hi], n[lo:hi])]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= reach
            yield i[near], j[near]
            lo = hi


def _compare(reach: int):
    def forest(table: pa.Table) -> pa.Table:
        """Edges from every point to the first of its component within the shard."""
        fp = table["fp"].to_numpy().view(np.uint64)
        node, left = table["node"].to_numpy(), table["left"].to_numpy(zero_copy_only=False)
        right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        label, homes = np.arange(len(fp)), np.flatnonzero(left)
        for i, j in _close(fp, homes, right, reach):
            merge_labels(label, i, j)
        joined = np.flatnonzero(label != np.arange(len(fp)))
        a, b = node[joined], node[label[joined]]
        apart = a != b
        return pa.table({"a": a[apart], "b": b[apart]})

    return forest


def links(points: DataFrame, reach: int, sample: int = SAMPLE, shard_points: int = SHARD_POINTS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Edges ``a, b`` between ``node`` numbers whose components are those of all pairs within ``reach``.

    ``points`` holds ``fp`` (distinct) and ``node``. A shard that is too large for one task is compared
    piece against piece; at 2.4 million points most shards are, so their pieces are a table, never an expression.
    """
    total = points.count()
    each = max(1, total // sample)
    chosen = points.filter(F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(each)) == 0).select("fp").toPandas()["fp"]
    chosen = np.sort(chosen.to_numpy(np.int64)).view(np.uint64)
    tree = points.sparkSession.sparkContext.broadcast(
        VantageTree(chosen, total / max(1, len(chosen)), reach, shard_points)
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 2000):
                part = fp[lo : lo + 2000]
                at, shard, home = tree.value.route(part.view(np.uint64))
                node = batch.column(1).slice(lo, 2000).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), node, pa.array(shard), pa.array(home)], names=["fp", "node", "shard", "home"])

    routed = materialize(points.select("fp", "node").mapInArrow(route, "fp long, node long, shard int, home boolean"))
    # visitors outnumber homes, and grow faster than the points: a shard is cut in as many pieces as either side needs
    rows, homes = F.count(F.lit(1)), F.count_if(F.col("home"))
    sizes = routed.groupBy("shard").agg(*[F.ceil(F.greatest(n, F.lit(1)) / task_rows).cast("int").alias(c) for n, c in ((homes, "_lefts"), (rows, "_rights"))])
    large = F.broadcast(sizes.filter("_rights > 1"))  # at most one row per shard of the bounded tree
    hashed, one = F.xxhash64("fp"), F.lit(1)
    dealt = routed.join(large, "shard", "left").withColumns({c: F.coalesce(c, one) for c in ("_lefts", "_rights")})
    dealt = dealt.withColumns({"_i": F.pmod(hashed, "_lefts").cast("int"), "_j": F.pmod(hashed, "_rights").cast("int")})
    yes, no = F.lit(True), F.lit(False)

    def place(i, j, left, right):
        return F.struct(i.alias("_i"), j.alias("_j"), left.alias("left"), right.alias("right"))

    def others(own: str, many: str):
        return F.filter(F.sequence(F.lit(0), F.col(many) - 1), lambda x: x != F.col(own))

    # a point meets its own piece in both roles, as a home the other pieces of visitors, and those of homes as a visitor
    own = F.array(place(F.col("_i"), F.col("_j"), F.col("home"), yes))
    as_left = F.transform(F.when(F.col("home"), others("_j", "_rights")).otherwise(F.array().cast("array<int>")), lambda j: place(F.col("_i"), j, yes, no))
    as_right = F.transform(others("_i", "_lefts"), lambda i: place(i, F.col("_j"), no, yes))
    tasks = dealt.select("fp", "node", "shard", F.explode(F.concat(own, as_left, as_right)).alias("_at")).select("fp", "node", "shard", "_at.*")
    return tasks.groupBy("shard", "_i", "_j").applyInArrow(_compare(reach), "a long, b long")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``a, b``: for every node with an edge to a smaller one, the smallest node it is connected with.

    Alternates two steps that keep components: larger neighbours move to a node's smallest neighbour, then
    smaller ones do. Only minima and joins are used, so the neighbours of a hub are never gathered.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = materialize(ordered.distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        large = materialize(large.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            return now
        mark = (row["n"], row["s"])


def components(
    docs: DataFrame,
    reach: int = 2,
    shingle_words: int = 3,
    key: str = "doc_id",
    text: str = "text",
    more_links: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """``key, fingerprint, component_id`` for every row.

    Fingerprints link at ``reach`` or fewer differing bits; ``component_id`` is the smallest key reachable.
    ``more_links`` (as in ``similar``) adds links that fingerprints do not show.
    Texts without words, null ones too, have fingerprint zero and link like any other. A null key counts
    as the smallest (and is then the ``component_id``); different texts under one key, or without one, are
    different documents, and repeated rows are linked; no rows give no rows.
    """
    source = identified(docs.select(key, text), key, text)
    found = _grouped(source, reach, shingle_words, key, text, more_links, options)
    return found.select(
        F.col("_id").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("root_id").cast("long").alias("component_id"),
    )


def _grouped(source: DataFrame, reach: int, shingle_words: int, key: str, text: str, more_links, options: dict) -> DataFrame:
    """``_id, _key, fp`` of every row of ``_doc, _key``, and ``root, root_id``: the smallest ``_key`` reachable and its id."""
    source = source.select(F.col("_doc").getField(key).alias("_id"), "_key", F.col("_doc").getField(text).alias("text"))
    prints = materialize(fingerprints(source, shingle_words, with_sets=more_links is not None))
    points = materialize(prints.groupBy("fp").agg(F.min("_key").alias("node"), F.min_by("_id", "_key").alias("node_id")))
    edges = links(points.select("fp", "node"), reach, **options)
    if more_links is not None:
        nodes = prints.join(points.select("fp", "node"), "fp").groupBy("_key").agg(F.min("node").alias("node"), F.min("shingles").alias("shingles"))
        edges = more_links(source.select("_key", "text"), materialize(nodes), edges)
    roots = smallest_reachable(edges)
    labelled = points.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    labelled = labelled.select("fp", F.coalesce("root", "node").alias("root"))
    labelled = labelled.join(points.select(F.col("node").alias("root"), F.col("node_id").alias("root_id")), "root")
    return prints.join(labelled, "fp")


def keep_one(
    docs: DataFrame,
    reach: int = 2,
    shingle_words: int = 3,
    key: str = "doc_id",
    text: str = "text",
    more_links: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Of ``docs``, one row per component: that of the smallest key (one of them, if the row is repeated)."""
    rows = identified(docs, key, text)
    found = _grouped(rows, reach, shingle_words, key, text, more_links, options)
    # most rows are the only one of their key, which stays: they need not be shuffled
    doubtful = found.groupBy("_key").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 or _key <> root")
    doubtful = materialize(doubtful.select("_key", (F.col("_key") != F.col("root")).alias("_goes")))
    rows = with_mark(rows, doubtful, "_key")
    sure = rows.filter("not _marked").select("_doc.*")
    goes = doubtful.filter("_goes").select("_key")
    others = rows.filter("_marked").join(goes.hint("merge"), "_key", "left_anti").dropDuplicates(["_key"])
    return sure.unionByName(others.select("_doc.*"))
