"""SQL (DuckDB) that states the results of those operators that SQL can express."""

from __future__ import annotations

from corpusforge.llm import fingerprints as P
from corpusforge.llm import quality as Q
from corpusforge.llm import urls as U

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""with d as (select doc_id, {WORDS} as w from documents),
    windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
    later as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from windows) where k > 1),
    gone as (select distinct doc_id, i + unnest(range(20)) as p from later),
    kept as (select a.doc_id, count(*) as n, string_agg(word, ' ' order by p) as s
        from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) a anti join gone using (doc_id, p) group by 1)
    select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
    from d left join kept on kept.doc_id = d.doc_id"""

FINGERPRINTS = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
    o as (select *, length(t) as n, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nx from d),
    e as (select *, substr(t, 1, n - n // 4) || substr(nx, 1, n // 4) as ed from o),
    texts as (select t as x from e union select ed from e),
    lines as (select x, unnest(string_split(x, chr(10))) as l, unnest(range(1, len(string_split(x, chr(10))) + 1)) as i from texts),
    broken as (select *, coalesce(sum((l = '' and i > 1)::int) over (partition by x order by i rows between unbounded preceding and 1 preceding), 0)
        as sec from lines),
    leaved as (select x, i, sec, list_transform(regexp_extract_all(l, '{P.CLAUSE}'), lambda c: sha256(c)) as leaves from broken),
    digested as (select x, i, sec, sha256(coalesce(array_to_string(leaves, ''), '')) as digest, list_transform(leaves, lambda c: c[1:{P.LEAF}]) as short from leaved),
    paragraphs as (select *, coalesce(sum(starts_with(digest, '{P.SECTION_END}')::int)
        over (partition by x, sec order by i rows between unbounded preceding and 1 preceding), 0) as sub from digested),
    sections as (select x, sec, sub, sha256(string_agg(digest, '' order by i)) as digest,
        string_agg(coalesce(array_to_string(short, ''), ''), '.' order by i) as body from paragraphs group by 1, 2, 3),
    trees as (select x, sha256(string_agg(digest, '' order by sec, sub)) as root,
        string_agg(digest[1:{P.NODE}] || '.' || body, '|' order by sec, sub) as body from sections group by 1),
    sets as (select x, list_distinct(flatten(list(short))) as leaves from paragraphs group by 1),
    f as (select trees.x, root, root || ':' || body as print, leaves from trees join sets on sets.x = trees.x)
    select doc_id, n::bigint as n_chars, sha256(ed) as edited_sha256, a.print as fingerprint, b.print as edited_fingerprint,
    case when a.root = b.root then 1.0 else coalesce(2.0 * len(list_intersect(a.leaves, b.leaves)) /
        nullif(len(a.leaves) + len(b.leaves), 0), 0.0) end as near_edited,
    case when a.root = c.root then 1.0 else coalesce(2.0 * len(list_intersect(a.leaves, c.leaves)) /
        nullif(len(a.leaves) + len(c.leaves), 0), 0.0) end as near_next
    from e join f a on a.x = e.t join f b on b.x = e.ed join f c on c.x = e.nx"""


def _host(url: str) -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{capitals}', '{capitals.lower()}')"


def url_sql() -> str:
    """Rules as one CASE from the longest on; every round of propagation is a CTE."""
    longest = sorted(U.RULES, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True)
    fits = [
        (f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in longest
    ]
    rule = " ".join(f"when {test} then '{name}'" for test, name, _ in fits)
    verdict = " ".join(f"when '{name}' then '{v}'" for _, name, v in fits)
    rounds = "".join(
        f""", s{i + 1} as materialized (select h.host, good + {U.DAMPING} * coalesce((select sum(n / total * s.trust) from edges e
        join s{i} s on s.host = e.src where e.dst = h.host), 0) as trust, bad + {U.DAMPING} * coalesce((select sum(n / into_total * s.distrust)
        from edges e join s{i} s on s.host = e.dst where e.src = h.host), 0) as distrust from hosts h)"""
        for i in range(U.ROUNDS)
    )
    link = """(?i)href\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]*)"""
    return f"""with p as (select page_id, html, {_host('url')} as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    r as (select *, case {rule} end as rule from p), v as (select *, case rule {verdict} end as fit from r),
    hosts as materialized (select host, count(*) filter (where fit = 'allow') / count(*) as good,
        count(*) filter (where fit = 'block') / count(*) as bad from v group by 1),
    links as (select host as src, {_host('u')} as dst from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as u from p)),
    counted as (select src, dst, count(*) as n from links where src <> '' and dst <> '' and src <> dst
        and dst in (select host from hosts) group by 1, 2),
    edges as materialized (select *, sum(n) over (partition by src) as total, sum(n) over (partition by dst) as into_total from counted),
    s0 as materialized (select host, good as trust, bad as distrust from hosts){rounds}
    select page_id, v.host, path, rule, coalesce(fit, case when v.host <> '' and distrust - trust > {U.THRESHOLD} then 'block' end, 'allow')
    as verdict from v join s{U.ROUNDS} s on s.host = v.host"""


def quality_sql(risk: float = 0.05, delta: float = 0.1) -> str:
    """Base rules, exact binomial tails term by term, fixed-order tests, chosen cutoffs, verdicts."""
    cuts = ", ".join(f"('{rule}', {step}, {cut}::double)" for rule, (_, cs) in Q.RULES.items() for step, cut in enumerate(cs))
    parts = {rule: expr.split(" / ") for rule, (expr, _) in Q.RULES.items()}
    scores = " union all ".join(
        f"select *, '{rule}' as rule, case when {low} <> 0 then ({top})::double / {low} else '-inf'::double end as score from base"
        for rule, (top, low) in parts.items()
    )
    share = risk / len(Q.RULES)
    term = "exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * ln({p}) + (n_good - i) * ln(1 - {p}))".format(p=share)
    return f"""with d as (select doc_id, lang, coalesce(text, '') as t, {WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from documents),
    grams as (select doc_id, i, count(*) over (partition by doc_id, g) as c from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
        from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d))),
    covered as (select doc_id, count(distinct i + k) as n from grams, (select unnest(range(3)) as k) where c > 1 group by 1),
    base as (select d.doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(t) - length(translate(t, '{Q.SYMBOLS}', '')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
        coalesce(n, 0) as n_repeat_words, len(ls) as n_lines, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
        from d left join covered on covered.doc_id = d.doc_id),
    scored as ({scores}), cuts as (select * from (values {cuts}) c(rule, step, cutoff)),
    marks as (select doc_id, min(quality) > 0 as good from labels where quality is not null group by 1),
    counts as (select lang, cuts.rule, step, cutoff, count(*) filter (where good) as n_good, count(*) filter (where not good) as n_bad,
        count(*) filter (where good and score > cutoff) as good_lost, count(*) filter (where not good and score > cutoff) as bad_caught
        from scored join marks using (doc_id) join cuts on cuts.rule = scored.rule where not base_failed group by 1, 2, 3, 4),
    tails as (select lang, rule, step, sum({term}) as tail from (select *, unnest(range(good_lost + 1)) as i from counts) group by 1, 2, 3),
    tested as (select c.*, max(case when good_lost < n_good * {share} then tail else 1.0 end) over (partition by c.lang, c.rule order by c.step)
        <= {delta} / ((select count(distinct coalesce(lang, chr(0))) from counts) * {len(Q.RULES)}) as certified,
        (bad_caught - good_lost) / greatest(n_bad, 1) as gain
        from counts c join tails on c.lang is not distinct from tails.lang and c.rule = tails.rule and c.step = tails.step),
    chosen as (select lang, rule, cutoff from (select *, row_number() over (partition by lang, rule order by gain desc, step) as k from tested
        where certified and gain >= {Q.LEAST_GAIN}) where k = 1),
    over as (select distinct doc_id from scored s join chosen c on c.lang is not distinct from s.lang and c.rule = s.rule and score > cutoff)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and doc_id not in (select doc_id from over) as kept from base"""


def _runs(source: str, target: str) -> str:
    """CTE ``target(g, h, i)``: the nodes above ``source(g, h, i)``; a group's last node stays as it is."""
    return f"""{target} as (select g, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h, i // 16 as i
        from (select *, count(*) over (partition by g) as n from {source}) group by g, i // 16)"""


def _climb(source: str, target: str, nodes: str) -> str:
    """CTE ``target``: paths one level up. A path has its node (g, i), the hash of its version and its siblings so far."""
    return f"""{target} as (select p.* replace (p.i // 16 as i,
            case when s.n = 1 then p.fold else sha256(array_to_string(s.lo, '') || p.fold || array_to_string(s.hi, '')) end as fold,
            p.proof || array_to_string(s.lo, '') || array_to_string(s.hi, '') as proof) from {source} p
        join (select a.g, a.i, any_value(n) as n,
                coalesce(list(b.h order by b.i) filter (where b.i < a.i), []) as lo, coalesce(list(b.h order by b.i) filter (where b.i > a.i), []) as hi
            from (select *, count(*) over (partition by g) as n from {nodes}) a join {nodes} b on a.g = b.g and a.i // 16 = b.i // 16 group by a.g, a.i) s
        on s.g = p.g and s.i = p.i)"""


def manifest_sql(levels: int = 6) -> str:
    """Leaves, ``levels`` levels in every source and over the sources, and every leaf's path through them."""
    columns = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"]
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in [*columns, text])})"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = f"translate(text, '{capitals}', '{capitals.lower()}')"
    bits = "list_reduce([{}] || range(8), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))"
    digits = "list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))"
    crc = f"xor(list_reduce([4294967295::bigint] || {digits}, lambda a, b: {bits.format('xor(a, b)')}), 4294967295)"
    parts = [
        f"""leaves as (select doc_id, source, {leaf('text')} as leaf, case when ({crc}) % 5 = 0 then {leaf(small)} else {leaf('text')} end as now from documents)""",
        "sources as (select source, row_number() over (order by source nulls first) - 1 as g from (select distinct source from documents))",
        """placed as (select l.*, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i
            from leaves l join sources s on l.source is not distinct from s.source)""",
        "n0 as (select g, leaf as h, i from placed)",
        "p0 as (select doc_id, leaf, g, i, now as fold, '' as proof from placed)",
    ]
    for k in range(levels):
        parts += [_climb(f"p{k}", f"p{k + 1}", f"n{k}"), _runs(f"n{k}", f"n{k + 1}")]
    parts += [
        f"m0 as (select 0 as g, h, g as i from n{levels})",
        f"q0 as (select p.doc_id, p.leaf, n.h as subroot, 0 as g, p.g as i, p.fold, p.proof from p{levels} p join n{levels} n on n.g = p.g)",
    ]
    for k in range(levels):
        parts += [_climb(f"q{k}", f"q{k + 1}", f"m{k}"), _runs(f"m{k}", f"m{k + 1}")]
    return f"""with {', '.join(parts)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = h as verified
        from q{levels}, m{levels}"""


PHRASES = r"""with pieces as (select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    n as (select lang, sum(len(w))::bigint as n from w group by 1),
    f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) t(k)) group by all),
    cand as (select * from f where k > 1 and f >= 10),
    cuts as (select lang, k, phrase, f as a, string_split(phrase, ' ') as x, unnest(range(1, k)) as cut from cand),
    scored as (select c.lang, c.k, c.phrase, a, cut, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score from cuts c
        join f l on l.lang = c.lang and l.phrase = array_to_string(x[:cut], ' ') and l.k = cut
        join f r on r.lang = c.lang and r.phrase = array_to_string(x[cut + 1:], ' ') and r.k = c.k - cut),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
    covered as (select lang, phrase, max(f) as longer from (select lang, f, unnest([array_to_string(x[:2], ' '), array_to_string(x[2:], ' ')]) as phrase
        from (select lang, f, string_split(phrase, ' ') as x from cand where k = 3)) group by all),
    kept as (select b.* from best b left join covered c on c.lang = b.lang and c.phrase = b.phrase where longer is null or 100 * longer < 50 * a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select ranked.lang, rank, phrase, a, l, r, n.n as n, score::bigint as score from ranked join n on n.lang = ranked.lang where rank <= 2000"""
