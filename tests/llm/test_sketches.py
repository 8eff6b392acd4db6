"""Sketches rule out chance candidates before any token set is made, and never a similar pair."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusforge.llm import lines, similar, simhash

from . import brute
from .test_operators import frame


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    r = np.random.default_rng(3)
    for n in (1, 2, 9, 31, 32, 33, 500, 5000):
        for share in (0.0, 0.05, 0.12, 0.5):
            a = r.integers(0, 1 << 63, n, np.uint64)
            b = np.unique(np.concatenate((a[int(n * share) :], r.integers(0, 1 << 63, int(n * share), np.uint64))))
            line, token = np.repeat([0, 1, 2], [len(a), len(b), len(a)]), np.concatenate((a, b, a))
            order = r.permutation(len(line))
            sizes, sketch = lines._sketches(line[order], token[order], 4)
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert sizes.tolist() == [len(a), len(b), len(a), 0] and sketch[0] == sketch[2]
            assert lines._differ(sketch[0], sketch[1]) <= apart and lines._differ(sketch[0], sketch[1]) % 2 == apart % 2
    sizes, sketch = lines._sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)
    assert len(sizes) == 0 and sketch == []


def chance_pairs():
    """Texts of which many share one run of words with another, and a few are near copies."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(60):
        shared = [word() for _ in range(6)]
        texts += [" ".join([word() for _ in range(120)] + shared + [word() for _ in range(80)]) for _ in range(2)]
    texts += [t.replace(t.split()[0], "other", 1) for t in texts[:3]]
    return list(enumerate(texts))


@pytest.mark.parametrize("whole", [False, True])
def test_chance_candidates_need_no_token_sets(spark, monkeypatch, whole):
    texts, asked, made = chance_pairs(), [], lines.token_sets

    def token_sets(docs, chosen, *rest):
        asked.append(chosen.distinct().count())
        return made(docs, chosen, *rest)

    monkeypatch.setattr(lines, "token_sets", token_sets)
    if whole:
        got = simhash.components(frame(spark, texts), reach=0, shingle_words=5, more_links=similar.more_links).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - 120 if d >= 120 else d for d, _ in texts}
    else:
        got = lines.dedup_lines(frame(spark, texts)).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in got} == brute.kept_without_similar_lines(texts)
    assert sum(asked) == 6
