"""Document fingerprints: Merkle trees over sections and paragraphs, with DataFrame functions only.

A text is cut, without losing a character, into sections, paragraphs (lines) and clauses. The content says
where: a clause ends behind a word with a certain last character (at the latest after a fixed number of
words), a section with a blank line or behind a paragraph whose digest begins with 0. So an edit changes
the clauses and sections it touches, and those behind it are cut as before. A clause's digest is its
SHA-256, a parent's the SHA-256 of its children's digests. The fingerprint writes the tree down: the root
in full, then for every section its digest's beginning and, for every paragraph, the beginnings of its
clauses' digests. Roots tell whether texts are equal; where they differ, the branches that differ tell where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import let
from corpusforge.session import materialize

#: Most words of a clause, and the last characters of a word that end one before that.
CLAUSE_WORDS, CLAUSE_ENDS = 16, ".,;:!?sy0-4"
#: Beginning of a paragraph's digest that ends a section.
SECTION_END = "0"
#: Hex digits kept of a clause's and of a section's digest.
LEAF, NODE = 8, 8
ROOT = 64
#: White space of the contracts, inside a character class.
_SPACE = r"\x20\x09-\x0D"
CLAUSE = (
    rf"[{_SPACE}]*(?:[^{_SPACE}]*[^{_SPACE}{CLAUSE_ENDS}][{_SPACE}]+){{0,{CLAUSE_WORDS - 1}}}[^{_SPACE}]+[{_SPACE}]*"
    rf"|[{_SPACE}]+"
)


def _clauses(paragraph: Column) -> Column:
    """Runs of words with the white space around them; together they are the paragraph."""
    return F.regexp_extract_all(paragraph, F.lit(CLAUSE), F.lit(0))


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _paragraph(paragraph: Column) -> Column:
    return let(
        F.transform(_clauses(paragraph), lambda c: F.sha2(c, 256)),
        lambda leaves: F.struct(
            _digest(leaves).alias("digest"),
            F.array_join(F.transform(leaves, lambda d: F.substring(d, 1, LEAF)), "").alias("leaves"),
        ),
    )


def _sections(text: Column) -> Column:
    """Arrays of paragraphs, as :func:`_paragraph` gives them."""

    def cut(paragraphs: Column) -> Column:
        def ends_here(p: Column, i: Column) -> Column:
            return F.startswith(p["digest"], F.lit(SECTION_END)) | (i == F.size(paragraphs) - 1)

        places = F.filter(F.transform(paragraphs, lambda p, i: F.when(ends_here(p, i), i + 1)), lambda e: e.isNotNull())

        def slices(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                start = F.coalesce(F.get(ends, k - 1), F.lit(0))
                return F.slice(paragraphs, start + 1, end - start)

            return F.transform(ends, one)

        return let(places, slices)

    # the blank line itself stays with the section before it, as an empty last paragraph
    parts = F.split(text, r"(?<=\n)\n", -1)
    return F.flatten(F.transform(parts, lambda part: let(F.transform(F.split(part, "\n", -1), _paragraph), cut)))


def fingerprint(text: Column) -> Column:
    """``root:section|section...``; a section is its digest and ``.``-separated paragraphs of leaf digests.

    Null is fingerprinted as the empty text.
    """
    text = F.coalesce(text, F.lit(""))

    def node(ps: Column) -> Column:
        return F.struct(
            _digest(F.transform(ps, lambda p: p["digest"])).alias("digest"),
            F.array_join(F.transform(ps, lambda p: p["leaves"]), ".").alias("leaves"),
        )

    return let(
        F.transform(_sections(text), node),
        lambda ns: F.concat(
            _digest(F.transform(ns, lambda s: s["digest"])),
            F.lit(":"),
            F.array_join(
                F.transform(ns, lambda s: F.concat(F.substring(s["digest"], 1, NODE), F.lit("."), s["leaves"])), "|"
            ),
        ),
    )


def root(print_: Column) -> Column:
    return F.substring(print_, 1, ROOT)


def _leaf_set(print_: Column) -> Column:
    """Distinct leaves of a fingerprint, each with its paragraph's text left out."""
    paragraphs = F.flatten(
        F.transform(
            F.split(F.substring(print_, ROOT + 2, 1 << 30), r"\|", -1),
            lambda s: F.slice(F.split(s, r"\.", -1), 2, 1 << 30),
        )
    )
    leaves = F.regexp_extract_all(F.array_join(paragraphs, ""), F.lit(f".{{{LEAF}}}"), F.lit(0))
    return F.array_distinct(leaves)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the leaves in common over the leaves of both (0 when one has none)."""
    shared = let(
        F.struct(_leaf_set(a).alias("a"), _leaf_set(b).alias("b")),
        lambda s: F.coalesce(
            2.0 * F.size(F.array_intersect(s["a"], s["b"])) / F.nullif(F.size(s["a"]) + F.size(s["b"]), F.lit(0)),
            F.lit(0.0),
        ),
    )
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(shared)


def changed_sections(a: Column, b: Column) -> Column:
    """Struct ``a, b``: 0-based places of each text's sections whose digest the other text does not have.

    Both are empty for equal roots, and where sections only changed places or number.
    """
    heads = [
        F.transform(F.split(F.substring(x, ROOT + 2, 1 << 30), r"\|", -1), lambda s: F.substring(s, 1, NODE))
        for x in (a, b)
    ]

    def only(these: Column, others: Column) -> Column:
        strange = let(F.array_except(these, others), lambda e: F.transform(these, lambda h, i: F.when(F.array_contains(e, h), i)))
        return F.filter(strange, lambda i: i.isNotNull())

    return let(
        F.struct(heads[0].alias("a"), heads[1].alias("b")),
        lambda h: F.struct(only(h["a"], h["b"]).alias("a"), only(h["b"], h["a"]).alias("b")),
    )


def _cuts(ids: DataFrame) -> Column:
    """The distinct ids in ascending order, as a constant array."""
    found = ids.distinct().sort("_id").select(F.to_json("_id", {"ignoreNullFields": "false"}).alias("j")).collect()
    return F.from_json(F.lit(f"[{','.join(r['j'] for r in found)}]"), f"array<{dict(ids.dtypes)['_id']}>")


def _cuts_upto(cuts: Column, id_: Column) -> Column:
    """How many of the ascending ``cuts`` are not above the id, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        right = (at["lo"] < at["hi"]) & (F.get(cuts, middle) <= id_)
        return F.struct(
            F.when(right, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(middle).alias("hi")
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, start, halve, lambda at: at["lo"])


def compare_with_next(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20, most_blocks: int = 100_000
) -> DataFrame:
    """Fingerprints of every text, of its edit, and their likenesses.

    The edit replaces the last quarter of the characters (rounded down) by the first as many of the next
    text in key order; after the last comes the first. Null keys come first, null texts are empty, rows
    that are equal give equal rows and count once in the order, and a single text is its own next.
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once: the key order is cut at a few hash-chosen rows into blocks of about ``block_bytes``
    (larger ones beyond ``most_blocks``), and a row at a cut goes to the block before as well, as the next
    text of that block's last. The cuts, one small struct per block, are all that the driver sees.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.struct(
        F.col("_key").alias("k"), F.xxhash64("_text").alias("h"), F.crc32(F.col("_text").cast("binary")).alias("c")
    )
    rows = docs.select(F.col(key).alias("_key"), content.alias("_text")).withColumn("_id", digest)
    narrow = materialize(
        rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_times"), F.max(F.octet_length("_text")).alias("_bytes"))
    )
    seen = narrow.agg(F.count(F.lit(1)).alias("n"), F.max("_times").alias("times"), F.sum(F.col("_bytes").cast("long")).alias("bytes")).first()
    several = (seen["times"] or 0) > 1
    if several:  # repeated rows are one row in the order, and come back at the end
        rows = rows.groupBy("_id").agg(
            F.first("_key").alias("_key"), F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_times")
        )
    blocks = min(most_blocks, 1 + (seen["bytes"] or 0) // block_bytes)
    chosen = F.pmod(F.xxhash64("_id.k", "_id.h", "_id.c"), F.lit(-(-seen["n"] // blocks))) == 0
    first = narrow.agg(F.min("_id").alias("_id")).filter("_id is not null")
    cuts = _cuts(first.union(narrow.filter(chosen).select("_id")) if blocks > 1 else first)

    def homes(found: Column) -> Column:
        """Blocks 1, 2, ... of a row: its own, and the one before if the row opens its block."""
        own = F.struct(found.alias("block"), F.lit(False).alias("guest"))
        before = F.struct(F.when(found > 1, found - 1).otherwise(F.size(cuts)).alias("block"), F.lit(True).alias("guest"))
        return F.when(F.get(cuts, found - 1) == F.col("_id"), F.array(own, before)).otherwise(F.array(own))

    moved = (
        rows.select("*", F.inline(let(_cuts_upto(cuts, F.col("_id")), homes)))
        .repartition("block")
        .withColumn("fingerprint", fingerprint(F.col("_text")))
    )
    order = Window.partitionBy("block").orderBy("guest", "_id")
    pairs = moved.withColumns({"_next": F.lead("_text").over(order), "_next_print": F.lead("fingerprint").over(order)}).filter("not guest")
    cut = F.floor(F.char_length("_text") / 4).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), F.char_length("_text") - cut), F.col("_next").substr(F.lit(1), cut))
    pairs = pairs.withColumn("_edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    out = pairs.select(
        F.col("_key").alias(key),
        F.char_length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
        *["_times"] * several,
    )
    if not several:
        return out
    # in two steps, so that a row repeated very often is never one huge array
    most = 100_000
    out = out.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / most))))
    here = F.least(F.lit(most), F.col("_times") - F.col("_part") * most).cast("int")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), here))).drop("_times", "_part", "_copy")
