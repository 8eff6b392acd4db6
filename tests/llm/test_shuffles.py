"""What set joins send, and that shorter ways to the same numbers give the same numbers."""

from __future__ import annotations

import random

import numpy as np

from corpusforge.llm import common, lines


def test_running_sums_give_the_hash_of_each_word_alone():
    r = random.Random(5)
    texts = [bytes(r.choice(b" \n\tab\xc3\x00\xff\x08\x0e") for _ in range(r.randint(0, 300))) for _ in range(40)]
    texts += [b"x" * 150_000 + b" y " + b"q" * 70_000 + b" " + b"w z\n" * 40_000, None, b""]
    found = common.Words(texts)
    words = [w for t in texts if t for w in t.split()]
    alone = {w: int(common.Words([w]).hash[0]) for w in set(words)}
    assert [alone[w] for w in words] == found.hash.tolist()
    assert len(set(alone.values())) == len(alone)


def test_order_by_one_number_is_the_order_by_three():
    r = np.random.default_rng(1)
    for tokens in (r.integers(0, 1 << 63, 5000, np.uint64), r.integers(0, 40, 5000).astype(np.uint64)):  # the latter tie in their first bits
        line, rank = r.integers(0, 300, 5000), (tokens % np.uint64(7)).astype(np.uint8)
        order, want = lines._by_line(line, rank, tokens), np.lexsort((tokens, rank, line))
        assert all((x[order] == x[want]).all() for x in (line, rank, tokens))


def test_numbers_come_back_from_planes():
    for top in (5, 200, 40_000, 1 << 40):
        x = np.random.default_rng(top).integers(-top, top, 100)
        short = common.narrow(x)
        assert common.from_planes(common.planes(short), short.itemsize).tolist() == x.tolist()
    assert common.narrow(np.array([-128, 127])).itemsize == 1 and common.narrow(np.array([-(1 << 63)])).itemsize == 8


def test_a_prefix_token_is_sent_in_few_bytes():
    r = random.Random(6)
    texts = ["\n".join(" ".join(f"w{r.randrange(9000)}" for _ in range(40)) for _ in range(5)).encode() for _ in range(200)]
    found = lines.Lines(texts)
    line, token, place, n, sets = lines._prefixes(found, np.zeros(lines.COUNTERS, np.uint8))
    held = [(line, token, place.astype(np.int32), sets, 10_000 + found.doc, found.number, n.astype(np.int32))]
    sent = list(lines._send(held, 7, 0))
    assert sum(len(x.as_py()) for b in sent for c in b.columns[1:] for x in c) < 25 * len(line)
