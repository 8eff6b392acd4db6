"""Pairs of documents of Jaccard similarity 4/5 or more on runs of five words, by the set join of ``lines``.

A whole document is joined as one line. All its similar partners matter here, not only an earlier one, as
groups follow chains of pairs. So after the first partners are verified, members of crowded tokens that are
not in one group yet are compared too; those that already are need no comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import lines
from corpusforge.llm.lines import mostly as _mostly  # noqa: F401
from corpusforge.llm.simhash import smallest_reachable
from corpusforge.session import materialize

SHINGLE_WORDS = lines.SHINGLE


def whole(texts: list[bytes | None], wanted: list[list[int]] | None = None) -> lines.Lines:
    """Every document as one line, in lower case as fingerprints take it."""
    return lines.Lines([t and t.lower().replace(b"\n", b" ") for t in texts], wanted)


def more_links(
    docs: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    block_bytes: int = lines.BLOCK_BYTES,
    held_entries: int = lines.HELD_ENTRIES,
) -> DataFrame:
    """``edges`` and those of similar documents: the components of both are those of all pairs of either kind.

    ``docs`` holds ``_key`` and ``text``, ``nodes`` one ``node`` per ``_key`` and the hash ``shingles`` of its set.
    """
    found = materialize(lines.candidates(docs, block_bytes, held_entries, whole))
    pairs = materialize(found.filter("kind = 1").select("_key", "line", "ref_key", "ref_line").distinct())
    crowd = found.filter("kind = 2").select("token", "_key", "line", "n", "place", "more")
    ends = pairs.select("_key", "line").unionByName(pairs.select(F.col("ref_key").alias("_key"), F.col("ref_line").alias("line")))
    chosen = ends.unionByName(crowd.select("_key", "line"))
    drawn = lines.sketches(docs, chosen, whole)

    first = nodes.groupBy("shingles").agg(F.min("node").alias("b"))
    equal = nodes.join(first, "shingles").select(F.col("node").alias("a"), "b")
    edges = edges.unionByName(equal).unionByName(_linked(lines.similar(pairs, drawn, docs, whole), nodes))
    edges = materialize(edges.filter("a <> b").distinct())
    if crowd.filter("more").isEmpty():
        return edges
    rest = _across(crowd, nodes, smallest_reachable(edges))
    return edges.unionByName(_linked(lines.similar(rest, drawn, docs, whole), nodes))


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select("_key", F.col("node").alias("a"))
    b = nodes.select(F.col("_key").alias("ref_key"), F.col("node").alias("b"))
    return pairs.join(a, "_key").join(b, "ref_key").select("a", "b")


def _across(crowd: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a token that were not paired and lie in different groups.

    A token's most frequent group meets only the members of others, so one large group costs no square.
    """
    root = nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    members = crowd.join(root.select("_key", F.coalesce("root", "node").alias("root")), "_key")
    members = materialize(members)
    sizes = members.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_size"))
    main = sizes.groupBy("token").agg(F.max_by("root", F.struct("_size", "root")).alias("main"), F.count(F.lit(1)).alias("_groups"))
    main = main.filter("_groups > 1").select("token", "main")
    others = members.join(main, "token").filter("root <> main").drop("main")
    earlier, n, m = lines.earlier("a", "b"), F.col("a.n"), F.col("b.n")
    most = F.least(n - F.col("a.place"), m - F.col("b.place"))
    fits = (
        (F.col("a.root") != F.col("b.root"))
        & F.when(earlier, F.col("b.more")).otherwise(F.col("a.more"))
        & (n * lines.DENOMINATOR >= m * lines.NUMERATOR)
        & (m * lines.DENOMINATOR >= n * lines.NUMERATOR)
        & (most * (lines.NUMERATOR + lines.DENOMINATOR) >= lines.NUMERATOR * (n + m))
    )
    met = others.alias("a").join(members.alias("b"), (F.col("a.token") == F.col("b.token")) & fits)
    small, large = F.struct("a._key", "a.line"), F.struct("b._key", "b.line")
    met = met.select(F.least(small, large).alias("x"), F.greatest(small, large).alias("y"))
    return met.select(
        F.col("y._key").alias("_key"), F.col("y.line").alias("line"), F.col("x._key").alias("ref_key"), F.col("x.line").alias("ref_line")
    )
