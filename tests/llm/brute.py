"""Plain Python versions of the operators, for small inputs only."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_without_repeated_windows(rows, window=20):
    """{doc_id: (n_words, n_removed, sha of what stays)}; rows are (doc_id, text)."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ws = words(text)
        gone = set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            else:
                seen[w] = (doc, i)
        out[doc] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def line_tokens(line):
    ws = words(line)
    if len(ws) < 5:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def kept_without_similar_lines(rows):
    """{doc_id: (n_lines, n_removed, kept text)}; rows are (doc_id, text)."""
    earlier, out, by_token = [], {}, defaultdict(list)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        keep, n, removed = [], 0, 0
        for line in (text or "").split("\n"):
            tokens = line_tokens(line)
            if not tokens:
                keep.append(line)
                continue
            n += 1
            near = Counter(j for t in tokens for j in by_token[t])
            if any(9 * c >= 4 * (len(tokens) + len(earlier[j])) for j, c in near.items()):
                removed += 1
            else:
                keep.append(line)
            for t in tokens:
                by_token[t].append(len(earlier))
            earlier.append(tokens)
        out[doc] = (n, removed, None if text is None else "\n".join(keep))
    return out


def simhash(text, k=3):
    import xxhash

    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest_linked(points, reach=2):
    """{doc_id: smallest doc_id reachable}; points are (doc_id, fingerprint)."""
    parent = {d: d for d, _ in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, f in points:
        by[f].append(d)
    for ds in by.values():
        for d in ds:
            a, b = find(ds[0]), find(d)
            parent[max(a, b)] = min(a, b)
    for f, g in combinations(by, 2):
        if (f ^ g).bit_count() <= reach:
            a, b = find(by[f][0]), find(by[g][0])
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def bins_of_best_fit(lengths, capacity):
    """Number of bins of item-by-item best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by exact fractions; sizes is {source: words}, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def edited(rows):
    """[(doc_id, text, edited text, next text)] in order of doc_id; rows are distinct (doc_id, text)."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((d, t, t[: len(t) - cut] + nxt[:cut], nxt))
    return out


def likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0

    def leaves(f):
        text = "".join("".join(s.split(".")[1:]) for s in f[65:].split("|"))
        return {text[i : i + 8] for i in range(0, len(text), 8)}

    x, y = leaves(a), leaves(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def base_rules(text):
    ws = words(text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = set()
    for i, g in enumerate(zip(ws, ws[1:], ws[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(ws)
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def binomial_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def url_verdicts(pages, rules, damping=0.85, rounds=20, threshold=0.5):
    """{page_id: (host, path, rule, verdict)}; pages are (page_id, url, links)."""
    fit, by_host, edges = {}, defaultdict(list), Counter()
    for p, url, links in pages:
        host, path = split_url(url)
        found = [
            (len(h + q), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)
        ]
        fit[p] = (host, path, *(max(found)[1:] if found else (None, None)))
        by_host[host].append(fit[p][3])
        for to in links:
            there = split_url(to)[0]
            if host and there and there != host:
                edges[host, there] += 1
    edges = {e: n for e, n in edges.items() if e[1] in by_host}
    seeds = {v: {h: x.count(v) / len(x) for h, x in by_host.items()} for v in ("allow", "block")}
    score = {}
    for v, flip in (("allow", False), ("block", True)):
        flow = {((b, a) if flip else (a, b)): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in flow.items():
            out[a] += n
        now = dict(seeds[v])
        for _ in range(rounds):
            new = dict(seeds[v])
            for (a, b), n in flow.items():
                new[b] += damping * now[a] * n / out[a]
            now = new
        score[v] = now
    return {
        p: (h, q, r, v or ("block" if h and score["block"][h] - score["allow"][h] > threshold else "allow"))
        for p, (h, q, r, v) in fit.items()
    }
