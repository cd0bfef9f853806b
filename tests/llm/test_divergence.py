"""Divergence of sources against whole-number brute force."""

import random
import re
from collections import Counter, defaultdict

from skein.llm.divergence import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, number int"


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1, 2) for i, r in enumerate(rows)], DOCS)


def brute(rows, least, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    times, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        groups[lang or ""].add(source or "")
        times[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        p = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        whole = p(sum((times[lang, s] for s in sources), Counter()))
        own = {s: p(times[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(whole[t] - own[s][t], t.encode(), t) for t in kept if times[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def test_both_parts_match_brute_force_over_many_blocks(spark):
    rng = random.Random(3)
    words = [a + b for a in ("Ab", "zé", "日", "q") for b in "abcdefgh"]
    rows = []
    for _ in range(300):
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é", "z", None])
        pool = words[: 10 + len(source or "")] if source != "s1" else words
        rows.append((" ".join(rng.choices(pool, k=rng.randint(0, 12))) + rng.choice(["", "_x9", ".Abİ"]), rng.choice(["en", "de", None]), source))
    rows += [(None, "fr", "none"), ("", "fr", "s0"), ("rare", "fr", "s1"), ("1 2 _", "en", "digits"), ("ab " * 9000, "en", "s2")]
    for k, slot, block in ((4, 3, 2), (50, 2048, 128)):
        got = divergence(docs(spark, rows), least=5, k=k, slot=slot, block=block).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 5, k)


def test_no_rows_and_no_terms(spark):
    assert divergence(docs(spark, [])).count() == 0
    got = divergence(docs(spark, [("a", "en", "x"), ("b", "en", "y"), ("b", "en", "y")])).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
