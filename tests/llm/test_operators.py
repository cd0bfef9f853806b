"""Edge cases, brute-force comparisons and round trips of the corpus operators."""

import hashlib
import random

import numpy as np
import pytest

from skein.llm import fingerprint as fp
from skein.llm.ann import nearest
from skein.llm.mixing import mix_documents
from skein.llm.neardup import near_duplicates
from skein.llm.packing import pack_documents, pack_sizes
from skein.llm.pii import find_private, sanitise
from skein.llm.secrets import RULES, find_secrets, trigram_query
from skein.llm.substring import dedup_substrings
from skein.llm.urlgraph import judge_pages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "word"), (None, "null id"), (4, "twice"), (4, "twice"), (5, "long " * 5000)]


@pytest.mark.parametrize("run", [find_private, find_secrets, fp.neighbour_likeness, dedup_substrings, mix_documents, near_duplicates])
def test_odd_rows_and_empty_tables(spark, run):
    assert run(docs(spark, ODD)).count() == len(ODD)
    assert run(docs(spark, [])).count() == 0


def test_private_spans_and_sanitising(spark):
    text = "mail Ann.Lee@mail.example.com or +1 (988) 555-2485, 10.0.0.256 10.1.2.3 card 4111 1111 1111 1111."
    row = find_private(docs(spark, [(1, text), (2, "nothing here")])).orderBy("doc_id").collect()
    assert (row[0].n_email, row[0].n_ip, row[0].n_card, row[0].n_phone) == (1, 1, 1, 1)
    kind, start, end = row[0].spans.split(",")[0].split(":")
    assert kind == "email" and text[int(start) : int(end)] == "Ann.Lee@mail.example.com"
    assert row[1].spans == "" and row[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = sanitise(docs(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    assert clean[0].text == "mail [EMAIL] or [PHONE], 10.0.0.256 [IP] card [CARD]." and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text is None


def test_secrets_and_trigram_queries(spark):
    text = 'x api_key = "abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef TOKEN:short'
    row = find_secrets(docs(spark, [(1, text)])).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    queries = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert queries["hex"] is None and queries["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in queries["assign"]


def brute_phrases(text):
    seen, out, start = set(), set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.add(text[start:end])
            start = end
    return out | ({text[start:]} if start < len(text) else set())


def test_fingerprints_share_a_parse_exactly():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for _ in range(2))
        own, other, changed = fp.fingerprint_pair(a, b)
        assert (own == fp.fingerprint(a)).all() and (other == fp.fingerprint(changed)).all()
        ends = fp.phrase_ends(a, {})
        starts = [0, *ends]
        assert {a[s:e] for s, e in zip(starts, [*ends, len(a)], strict=True) if s < e} == brute_phrases(a)


def test_neighbours_follow_doc_ids(spark):
    rows = [(i, "".join(random.Random(i).choices("abcdef ", k=300))) for i in range(40)]
    out = {r.doc_id: r for r in fp.neighbour_likeness(docs(spark, rows[::-1])).collect()}
    for i, text in rows:
        following = rows[(i + 1) % len(rows)][1]
        assert out[i].edited_sha256 == hashlib.sha256(fp.edited(text, following).encode()).hexdigest()
        assert out[i].near_next == pytest.approx(fp.likeness(fp.fingerprint(text), fp.fingerprint(following)))
    assert np.mean([r.near_edited for r in out.values()]) > np.mean([r.near_next for r in out.values()])


def test_packing_loses_nothing_and_fits(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 5, 5, 300, 4096, 4097, 9000])]
    out = pack_documents(docs(spark, rows + rows[:3]), shard_pieces=4).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == {1: 2, 2: 10, 3: 5, 4: 300, 5: 4096, 6: 4097, 7: 9000}
    bins = out.groupby(["shard", "bin"])
    assert (bins["length"].sum() == bins["in_bin"].first()).all() and (out["in_bin"] <= out["capacity"]).all()
    for _, b in bins:
        b = b.sort_values("at")
        assert (b["at"].to_numpy() == np.r_[0, b["length"].cumsum().to_numpy()[:-1]]).all()


def test_joint_plan_is_never_dearer():
    sizes = np.sort(np.random.default_rng(3).integers(1, 900, 500))[::-1]
    cost = lambda caps: sum(c + 0.25 * c * c / 1024 for c in pack_sizes(sizes, caps, 0.25)[2])
    assert cost((256, 512, 1024)) <= cost((1024,))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((300, 16))
    vectors[5] = vectors[100] = vectors[101] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        score = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert out[out.query_id == q].sort_values("rank").vec_id.tolist() == want
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_near_duplicates_against_sets(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(base[:100])), (4, " ".join(base).upper())]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_substrings_go_once(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(docs(spark, [(1, f"a {shared} b"), (2, f"c {shared} d"), (3, "short")])).collect()}
    assert got == {1: (62, 0), 2: (62, 60), 3: (1, 0)}


def test_exact_copies_lose_what_windows_cover(spark):
    text = " ".join(f"c{i}" for i in range(55))
    got = {(r.doc_id, r.n_removed) for r in dedup_substrings(docs(spark, [(1, text), (2, text), (2, text), (None, text), (3, "a b"), (4, "a b")])).collect()}
    assert got == {(1, 0), (2, 55), (None, 55), (3, 0), (4, 0)}


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.example.NET/en/x", None), (2, "https://b.net/de", ""), (3, None, ""), (4, "no scheme", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in judge_pages(pages).collect()}
    assert got == {1: ("a.example.net", "example.net/en/", "allow"), 2: ("b.net", "net/", "block"), 3: ("", None, "allow"), 4: ("", None, "allow")}


def test_families_at_the_threshold_match_brute_force(spark, monkeypatch):
    import random

    from skein.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, rows = random.Random(5), []
    for family in range(4):
        base = [f"w{family}x{i}" for i in range(120)]
        for _ in range(45):
            words = list(base)
            for at in rng.sample(range(120), rng.randint(0, 6)):
                words[at] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == {i: top(i) for i in range(len(rows))}
    assert 10 < len(set(got.values())) < 170
