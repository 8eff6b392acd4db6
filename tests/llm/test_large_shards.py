"""Trees of which most shards are too large for one task, as on millions of fingerprints."""

from __future__ import annotations

import numpy as np

from corpusforge.llm import simhash


def test_many_large_shards(spark):
    # before, every large shard was one more level of an expression: StackOverflowError
    random = np.random.default_rng(5)
    fp = random.integers(-(1 << 63), 1 << 63, 8_000, dtype=np.int64)
    fp = np.unique(np.concatenate((fp, fp[:2_000] ^ np.int64(5), fp[:1_000] ^ np.int64(1 << 40))))
    points = spark.createDataFrame([(int(f), n) for n, f in enumerate(fp)], "fp long, node long")
    edges = simhash.links(points, 3, shard_points=4, task_rows=8)
    found = {r["a"]: r["b"] for r in simhash.smallest_reachable(edges).collect()}
    bits = fp.view(np.uint64)
    want = np.arange(len(fp))
    for lo in range(0, len(fp), 500):
        i, j = np.nonzero(np.bitwise_count(bits[lo : lo + 500, None] ^ bits) <= 3)
        simhash.merge_labels(want, i + lo, j)
    assert found == {n: int(root) for n, root in enumerate(want) if n != root}
    assert len(found) >= 2_000


def test_close_pairs_are_all_pairs(monkeypatch):
    random = np.random.default_rng(3)
    spread = random.integers(0, 1 << 63, 300, dtype=np.uint64)
    dense = spread[0] ^ (np.uint64(1) << random.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 300, dtype=np.uint64))
    homes, right = np.flatnonzero(random.random(300) < 0.6), np.flatnonzero(random.random(300) < 0.8)
    for fp in (spread, dense):
        fp = np.concatenate((fp[:150], fp[:150] ^ (np.uint64(1) << random.integers(0, 64, 150, dtype=np.uint64))))
        for reach in (0, 2, 3, 7, 64):
            want = {(int(a), int(b)) for a in homes for b in right if int(fp[a] ^ fp[b]).bit_count() <= reach}
            for cells in (40, 1 << 21):
                monkeypatch.setattr(simhash, "_CELLS", cells)
                found = simhash._close(fp, homes, right, reach)
                assert {(int(a), int(b)) for i, j in found for a, b in zip(i, j)} == want
