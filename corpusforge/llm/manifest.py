"""Merkle manifest of a dataset, kept as a persistent tree by path copying.

Rows are leaves, ordered by key within their group; every 16 neighbours become one node, and the groups'
roots, ordered by group, are the leaves of the tree above them. A block is an aligned run of 4096 leaves,
three levels, and is built by one task; block roots are again rows of a table, cut into blocks, until one
node is left. So levels inside blocks are work of tasks and levels above them are tables of 1/4096 the size.

A changed leaf makes a version: it shares every node of the tree but its ancestors. These are copied
inside the block, and the version goes on above it along the block's path, which is joined to the block
once. Blocks are dealt to packs of tasks by hash; no task holds more than its pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import materialize

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
PACK_LEAVES, PIECE_ROWS = 1 << 16, 200_000
#: The columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def node(digests: list[bytes]) -> bytes:
    """Hash of children: their digests as hexadecimal text, end to end."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Tree:
    """The levels of one block, and versions that copy only a path of it."""

    def __init__(self, leaves: list[bytes], whole: bool):
        """``whole`` says that the block is all of its group: then it ends at one node, else after all levels."""
        self.levels = [leaves]
        while len(self.levels) <= LEVELS and (len(self.levels[-1]) > 1 or not whole):
            below = self.levels[-1]
            self.levels.append([node(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        self.root = self.levels[-1][0]

    def path(self, at: int) -> list[tuple[list[bytes], list[bytes]]]:
        """Per level the siblings before and after."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % FAN
            out.append((level[first:at], level[at + 1 : first + FAN]))
            at //= FAN
        return out


def version(changed: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """The copied nodes of a version, from the changed leaf up; every other node is the tree's own."""
    copies = [changed]
    for before, after in path:
        copies.append(node([*before, copies[-1], *after]))
    return copies


def _joined(siblings: list[list[bytes]]) -> bytes:
    return b"".join(d for part in siblings for d in part)


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + 32] for i in range(0, len(digests), 32)]


def placed(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``idx``, the 0-based place in the group by ``key`` and ``leaf``, and ``total``, the group's size.

    ``rows`` has ``grp, key, leaf``. Ranges of the order are counted per group; a group that fills many
    ranges is numbered in each of them apart.
    """
    order = ["grp", "key", "leaf", "_salt"]
    rows = materialize(rows.withColumn("_salt", F.monotonically_increasing_id()))  # parts equal rows
    pieces = max(1, -(-rows.count() // piece_rows))
    ranged = materialize(rows.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))
    counts = materialize(ranged.groupBy("grp", "_piece").agg(F.count(F.lit(1)).alias("_n")))
    by_group = Window.partitionBy("grp")
    before = F.sum("_n").over(by_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("grp").alias("_g"), F.col("_piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by_group).alias("total")
    )
    here = F.row_number().over(Window.partitionBy("grp", "_piece").orderBy("key", "leaf")) - 1
    same = F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p"))
    numbered = ranged.withColumn("idx", here.cast("long")).join(offsets, same)
    return numbered.withColumn("idx", F.col("idx") + F.col("_before")).drop("_piece", "_g", "_p", "_before", "_salt")


def _packs(rows: DataFrame) -> Column:
    """Pack of a row's block; ``rows`` has ``g`` and ``idx``."""
    packs = max(1, -(-rows.count() // PACK_LEAVES))
    return F.pmod(F.xxhash64("g", F.floor(F.col("idx") / BLOCK)), F.lit(packs)).cast("int")


def _blocks(table: pa.Table, digest: str) -> Iterator[tuple[int, int, np.ndarray, Tree]]:
    """Group, block number, row places in order, and tree of every block of a pack."""
    g, idx, total = (table.column(c).to_numpy() for c in ("g", "idx", "total"))
    digests = table.column(digest).to_pylist()
    order = np.lexsort((idx, g))
    block = idx[order] // BLOCK
    edges = np.flatnonzero(np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (block[1:] != block[:-1]), [True])))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows = order[lo:hi]
        yield int(g[rows[0]]), int(block[lo]), rows, Tree([digests[i] for i in rows.tolist()], int(total[rows[0]]) <= BLOCK)


def block_roots(rows: DataFrame) -> DataFrame:
    """``g, idx, total, digest`` of the blocks over ``g, idx, total, digest``."""

    def roots(table: pa.Table) -> pa.Table:
        found = [(g, b, t.root) for g, b, _, t in _blocks(table, "digest")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], names=["g", "idx", "digest"])

    packed = rows.select(_packs(rows).alias("_pack"), "g", "idx", "total", "digest")
    up = packed.groupBy("_pack").applyInArrow(roots, "g long, idx long, digest binary")
    sizes = rows.filter("idx = 0").select(F.col("g").alias("_g"), F.ceil(F.col("total") / BLOCK).alias("total"))
    return materialize(up.join(sizes, F.col("g") == F.col("_g")).drop("_g"))


def tiers(rows: DataFrame) -> list[DataFrame]:
    """Tables of nodes, each a block's height above the one before, up to one node per group."""
    out = [rows]
    while True:
        out.append(block_roots(out[-1]))
        if out[-1].filter("total > 1").isEmpty():
            return out


_UP = "up array<struct<before:binary,after:binary>>"


def with_paths(rows: DataFrame, above: DataFrame | None) -> DataFrame:
    """``g, idx, up``: the path of every node to its group's root; ``above`` has the paths of the blocks' roots."""
    plain = pa.struct([("before", pa.binary()), ("after", pa.binary())])

    def top(table: pa.Table) -> pa.Table:
        return climb(table, None)

    def climb(table: pa.Table, higher: pa.Table | None) -> pa.Table:
        ups = {} if higher is None else {(h["g"], h["idx"]): h["up"] for h in higher.select(["g", "idx", "up"]).to_pylist()}
        gs, at, paths = [], [], []
        idx = table.column("idx").to_numpy()
        for g, b, places, tree in _blocks(table, "digest") if table.num_rows else ():
            rest = ups.get((g, b), [])
            for i, row in enumerate(places.tolist()):
                gs.append(g)
                at.append(int(idx[row]))
                paths.append([{"before": _joined([x]), "after": _joined([y])} for x, y in tree.path(i)] + rest)
        return pa.table([pa.array(gs, pa.int64()), pa.array(at, pa.int64()), pa.array(paths, pa.list_(plain))], names=["g", "idx", "up"])

    pack = _packs(rows)
    packed = rows.select(pack.alias("_pack"), "g", "idx", "total", "digest").groupBy("_pack")
    if above is None:
        return materialize(packed.applyInArrow(top, f"g long, idx long, {_UP}"))
    return materialize(packed.cogroup(_by_pack(rows, above)).applyInArrow(climb, f"g long, idx long, {_UP}"))


def _by_pack(rows: DataFrame, above: DataFrame):
    """A table of blocks (``g, idx`` and more), grouped as :func:`_packs` deals the rows of the blocks."""
    packs = max(1, -(-rows.count() // PACK_LEAVES))
    return above.select(F.pmod(F.xxhash64("g", "idx"), F.lit(packs)).cast("int").alias("_pack"), "*").groupBy("_pack")


def all_paths(levels: list[DataFrame]) -> DataFrame:
    """``g, idx, up`` of the blocks over the lowest tier."""
    above = None
    for nodes in reversed(levels[1:]):
        above = with_paths(nodes, above)
    return above


def build(docs: DataFrame, columns=COLUMNS, key: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None) -> "Manifest":
    """Leaves, tiers and roots of ``docs``. ``changed`` gives columns of tampered rows, null where nothing is tampered.

    Rows ascend by key within their group, null first, equal keys by their leaf; a null group comes first.
    Null fields are told from empty ones; repeated rows are leaves of their own; columns that are not named
    are not covered. Without rows there is no root.
    """
    changed = changed or {}
    original = [F.col(c) for c in columns]
    tampered = [F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c) for c in columns]
    touched = reduce(lambda a, b: a | b, [x.isNotNull() for x in changed.values()], F.lit(False))
    rows = docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), leaf(original).alias("leaf"), F.when(touched, leaf(tampered)).alias("changed")
    )
    return Manifest(materialize(placed(rows)))


class Manifest:
    """``leaves``: grp, g, key, idx, total, leaf, changed; ``groups``: g, grp and subroot; ``root``."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        # groups are numbered as leaves of the tree above them: their order is their key
        sizes = rows.filter("idx = 0").select(F.lit(0).alias("one"), "grp", "total")
        names = placed(sizes.select(F.col("one").alias("grp"), F.col("grp").alias("key"), F.lit(b"").alias("leaf")))
        names = materialize(names.select(F.col("key").alias("_grp"), F.col("idx").alias("g"), F.col("total").alias("groups")))
        self.leaves = materialize(rows.join(names.drop("groups"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp"))
        self.tiers = tiers(self.leaves.select("g", "idx", "total", F.col("leaf").alias("digest")))
        subroots = self.tiers[-1].select(F.col("g").alias("idx"), "digest")
        self.groups = names.join(subroots.withColumnRenamed("idx", "g"), "g").select("g", F.col("_grp").alias("grp"), "groups", F.col("digest").alias("subroot"))
        top = self.groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("groups").alias("total"), F.col("subroot").alias("digest"))
        self.top = tiers(materialize(top))
        self.root = self.top[-1].select(F.col("digest").alias("root"))

    def versions(self) -> DataFrame:
        """``g, idx, key, leaf, changed, subroot, root, proof, copies``, one row per leaf.

        ``proof`` are the siblings' digests up to the root, level by level from left to right. ``copies`` are
        the copied nodes of the leaf's version, from the changed leaf to the root (of an unchanged one: the
        nodes of the tree itself, computed again from the leaf and the siblings).
        """
        block_up = all_paths(self.tiers)
        above = all_paths(self.top)
        top_up = with_paths(self.top[0], above)
        groups = self.groups.select("g", "subroot").join(top_up.select(F.col("idx").alias("g"), F.col("up").alias("top_up")), "g")
        blocks = block_up.join(groups, "g")
        blocks = materialize(blocks.select("g", "idx", F.concat("up", "top_up").alias("up"), "subroot"))

        def follow(table: pa.Table, higher: pa.Table) -> pa.Table:
            ups = {(h["g"], h["idx"]): h for h in higher.select(["g", "idx", "up", "subroot"]).to_pylist()}
            leaves, changed = table.column("leaf").to_pylist(), table.column("changed").to_pylist()
            places, found = [], []
            for g, b, rows, tree in _blocks(table, "leaf") if table.num_rows else ():
                up = ups[(g, b)]["up"]
                high = [(_split(u["before"]), _split(u["after"])) for u in up]
                high_siblings = b"".join(u["before"] + u["after"] for u in up).hex()
                root = version(tree.root, high)[-1]
                for i, row in enumerate(rows.tolist()):
                    path = tree.path(i)
                    siblings = b"".join(_joined([x, y]) for x, y in path).hex() + high_siblings
                    now = leaves[row] if changed[row] is None else changed[row]
                    places.append(row)
                    found.append((ups[(g, b)]["subroot"], root, hashlib.sha256(siblings.encode()).digest(), version(now, path + high)))
            kept = [table.column(c).take(pa.array(places, pa.int64())) for c in names[:5]]
            new = zip(zip(*found) if found else [()] * 4, [pa.binary()] * 3 + [pa.list_(pa.binary())])
            return pa.table(kept + [pa.array(c, t) for c, t in new], names=names)

        names = ["g", "idx", "key", "leaf", "changed", "subroot", "root", "proof", "copies"]
        kind = dict(self.leaves.dtypes)["key"]
        schema = f"g long, idx long, key {kind}, leaf binary, changed binary, subroot binary, root binary, proof binary, copies array<binary>"
        packed = self.leaves.select(_packs(self.leaves).alias("_pack"), "g", "idx", "total", "key", "leaf", "changed").groupBy("_pack")
        return packed.cogroup(_by_pack(self.leaves, blocks)).applyInArrow(follow, schema)


def tampered_proofs(docs: DataFrame, columns=COLUMNS, key: str = "doc_id", group: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row, digests in hexadecimal.

    Rows whose key's CRC-32 is divisible by ``every`` are tampered with: their text's capitals A-Z become
    small letters. A row is verified if its version ends in the root; a null key or text is not tampered with.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    changed = {text: F.when(chosen, F.translate(F.col(text), capitals, capitals.lower()))}
    found = build(docs, columns, key, group, changed).versions()
    hexed = {c: F.lower(F.hex(F.col(c))) for c in ("leaf", "subroot", "root", "proof")}
    folded = F.element_at("copies", -1)
    return found.select(
        F.col("key").alias(key), hexed["leaf"].alias("leaf"), hexed["subroot"].alias("subroot"), hexed["root"].alias("root"),
        hexed["proof"].alias("proof_sha256"), F.lower(F.hex(folded)).alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
