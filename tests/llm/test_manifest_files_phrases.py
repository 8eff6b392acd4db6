"""Manifest, token files and phrases against plain Python, on hard small inputs."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusforge.llm import manifest, phrases, tokenfiles
from corpusforge.llm.tokens import encoder

FOLDER = "/root/testdata/sf0.01"
CAPITALS = re.compile("[A-Z]")


def small(text):
    return CAPITALS.sub(lambda m: m.group().lower(), text)


# --- manifest -------------------------------------------------------------------------------------------


def hashed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashed(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: hashed([*map(field, r[:4]), field(text)])
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        placed = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in by[s])
        trees[s] = [r for _, r in placed], levels_of([k[2] for k, _ in placed])
    top, out = levels_of([trees[s][1][-1][0] for s in order]), []
    for j, s in enumerate(order):
        rs, levels = trees[s]
        for i, r in enumerate(rs):
            path = path_of(levels, i) + path_of(top, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold = leaf(r, small(r[4]) if hit else r[4])
            for a, b in path:
                fold = hashed(a + [fold] + b)
            root = top[-1][0]
            out.append((r[0], levels[0][i], levels[-1][0], root, hashed([x for a, b in path for x in a + b]), fold, fold == root))
    return sorted(out, key=repr)


ROW = "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf int, idx int"


def manifest_rows(seed, n, source):
    r = random.Random(seed)
    return [
        (
            r.choice([None, r.randrange(n)]) if r.random() < 0.1 else i,
            source(r),
            r.choice([None, "en", ""]),
            r.choice([None, 3]),
            r.choice([None, "", "Ab:É", "-", "A" * 5000]),
            "x",
            1,
            2,
        )
        for i, _ in enumerate(range(n))
    ]


@pytest.mark.parametrize(
    "rows",
    [
        manifest_rows(1, 600, lambda r: r.choice([None, "", "a", "é", "Z"])),
        manifest_rows(2, 300, lambda r: str(r.randrange(10**6))),
        manifest_rows(3, 4500, lambda r: "a"),
        [(1, "s", "l", 1, "T", "x", 1, 1)] * 300 + [(None,) * 8] * 200,
        [(1, "s", "l", 1, "T", "x", 1, 1)],
        [],
    ],
    ids=["mixed", "many sources", "several blocks", "equal rows", "one", "none"],
)
def test_manifest_equals_a_plain_tree(spark, rows):
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    assert sorted(map(tuple, manifest.tampered_proofs(docs).collect()), key=repr) == plain_manifest([r[:5] for r in rows])


def test_a_version_copies_one_node_per_level_and_shares_the_rest():
    leaves = [bytes([i % 256]) * 32 for i in range(300)]
    tree = manifest.Tree(leaves, True)
    changed = manifest.Tree([*leaves[:77], b"x" * 32, *leaves[78:]], True)
    copies = manifest.version(b"x" * 32, tree.path(77))
    assert len(copies) == len(tree.levels) and copies[-1] == changed.root
    for level, (old, new) in enumerate(zip(tree.levels, changed.levels)):
        assert [i for i, (a, b) in enumerate(zip(old, new)) if a != b] == [77 // 16**level]
        assert new[77 // 16**level] == copies[level]


# --- token files ----------------------------------------------------------------------------------------


def plain_ids(rows):
    """(key, n, crc) in key order, and the starts by position."""
    out = []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoder("word_bpe_49k.json").library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((k, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    return out


def by_start(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[1])


def token_rows():
    r = random.Random(3)
    texts = [None, "", "Hi there", "x y  z É 日本 <|endoftext|>", "same"]
    return [(r.choice([None, 7, 7, 7, i]), r.choice(texts)) for i in range(2000)] + [(10**12, "word " * 5000)]


@pytest.mark.parametrize("rows", [token_rows(), [(None, None)] * 3, [(-5, "a"), (3, None)], []], ids=["mixed", "nulls", "two", "none"])
def test_token_files_round_trip(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, ids int")
    place = f"file://{tmp_path}/{uuid.uuid4().hex}"
    shards = tokenfiles.write_ids(docs, place, shard_bytes=3000)
    got = by_start(tokenfiles.read_documents(spark, place, read_ids=1000))
    order = lambda xs: sorted(xs, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert order([(r[0], *r[2:]) for r in got]) == order(plain_ids(rows))
    assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in got)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()][: len(got)]
    assert shards.count() >= (2 if len(rows) > 1000 else 0)
    keys = spark.createDataFrame([(7,), (10**12,), (-5,), (10**11,), (None,)], "doc_id long")
    found = tokenfiles.lookup(keys, place).collect()
    assert order([(r[0], r[1], r[2], zlib.crc32(r[3])) for r in found]) == order([r for r in got if r[0] in (7, 10**12, -5)])


def test_perfect_hash_is_minimal_and_fingerprints_tell_strangers():
    keys = np.random.default_rng(1).choice(10**12, 50_000, replace=False).astype(np.int64)
    table = tokenfiles.PerfectHash.build(keys)
    assert np.array_equal(np.sort(table.find(keys)), np.arange(len(keys)))
    assert len(table.words) * 64 < 5 * len(keys)
    index = tokenfiles.Index.load(tokenfiles.Index.build(np.sort(keys), 0, np.ones(len(keys), np.int64), 2).dump())
    assert index.find(keys)[1].min() == 1
    assert index.find(-1 - keys)[1].max() == 0
    assert tokenfiles.Index.load(tokenfiles.Index.build(keys[:0], 0, keys[:0], 2).dump()).find(keys)[1].max() == 0


# --- phrases --------------------------------------------------------------------------------------------


def plain_phrases(rows, top, least, longest, cover=50):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        ranked = []
        for p, a in found.items():
            if len(p) > 1 and not (longer[p] and 100 * longer[p] >= cover * a):
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((" ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
        ranked.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(ranked[:top])]
    return sorted(out)


PHRASE = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


@pytest.mark.parametrize("least, longest, sample, held", [(10, 3, 0.25, 8 << 20), (3, 4, 0.05, 300), (2, 5, 0.5, 2000), (2, 3, 0.0, 5000)])
def test_phrases_equal_plain_counts_whatever_the_sample(spark, least, longest, sample, held):
    r = random.Random(least)
    words = ["a", "B", "b", "c", "É", "é", "x,y", "z.", "w\x0bw", "long" * 500]
    rows = [
        (r.choice([None, "und", "en", "t\ta b"]), r.choice([None, "", "\t ", " ".join(r.choice(words) for _ in range(r.randint(1, 40)))]), 1)
        for _ in range(250)
    ]
    rows += [("en", "a a a a b c a a a", 2)] * 60
    docs = spark.createDataFrame(rows, "lang string, text string, n int").repartition(5)
    found = phrases.collocations(docs, 60, least, longest, sample=sample, held_bytes=held).select(*PHRASE)
    assert sorted(map(tuple, found.collect())) == plain_phrases([x[:2] for x in rows], 60, least, longest)


def test_failures_of_the_border_are_found_by_a_further_pass(spark, monkeypatch):
    """Without a sample nothing is proposed: every word fails, and the second pass over all documents closes."""
    passes = []
    counted = phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda d, rounds, *a: passes.append(len(rounds)) or counted(d, rounds, *a))
    docs = spark.createDataFrame([("en", "one two three four")] * 12, "lang string, text string")
    found = {r["phrase"] for r in phrases.frequent_phrases(docs, 10, 3, sample=0.0).collect()}
    assert found == {"", "one", "two", "three", "four", "one two", "two three", "three four", "one two three", "two three four"}
    assert passes == [1, 1, 2]


def test_no_documents_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).isEmpty()
