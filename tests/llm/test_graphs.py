"""Near-duplicates, substrings, components and link graphs on hard cases, and the pipeline's stages."""

import random

import numpy as np
import pytest

from skein.llm import neardup, urlgraph
from skein.llm.components import connected_components
from skein.llm.mixing import mixed_rows
from skein.llm.substring import dedup_substrings
from skein.session import saved

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, own string, at string, key string, row string, kept_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", 1) for i, t in rows], DOCS)


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_of_few_letters_do_not_collide(spark):
    x, y = thue_morse(13)
    assert len(x) == 8192
    texts = [(i, " ".join(f"{w} w{j}" for j in range(40))) for i, w in ((1, x), (2, y))]
    assert {r.doc_id: r.n_removed for r in dedup_substrings(docs(spark, texts)).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts)).collect()} == {1: 1, 2: 2}


def test_rows_of_one_id_are_one_node(spark):
    text = lambda s, n=60: " ".join(f"{s}{i}" for i in range(n))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("b")), (5, None), (8, None), (9, text("c")), (None, text("a"))]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows)).collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (5, 3, False), (8, 8, True), (9, 9, True)])
    kept = neardup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted((r.doc_id or 0, r.kept_id) for r in kept.collect()) == [(0, 1), (3, 1), (8, 1), (9, 1)]
    assert neardup.keep_one(docs(spark, [])).count() == 0


def test_wanted_texts_meet_alike_whether_broadcast_or_shuffled(spark):
    frame, wanted = spark.range(100).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(3,), (5,), (5,), (200,)], "x long")
    assert [sorted(r.doc_id for r in neardup.among(frame, "doc_id", wanted, most).collect()) for most in (0, 100)] == [[3, 5], [3, 5]]


def test_components_with_a_hub_and_long_chains(spark):
    rng = random.Random(3)
    pairs = [(5000, i) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(300)] + [(rng.randrange(20_000, 20_200), rng.randrange(20_000, 20_200)) for _ in range(150)]
    root = {n: n for p in pairs for n in p}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: top(n) for a, b in pairs if a != b for n in (a, b)}


def test_a_passage_that_most_documents_share(spark):
    passage = [f"p{i}" for i in range(55)]
    rows = [(i, " ".join([f"x{i}", *passage, f"y{i}"])) for i in range(400)]
    assert {(r.doc_id, r.n_removed) for r in dedup_substrings(docs(spark, rows)).collect()} == {(i, 55 if i else 0) for i in range(400)}


def test_windows_against_brute_force(spark):
    rng = random.Random(12)
    pool = [[rng.choice("abc") for _ in range(rng.randint(3, 9))] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(pool))) for i in range(40)]
    words = [t.split() for _, t in rows]
    first = {}
    for i, w in enumerate(words):
        for a in range(len(w) - 7):
            first.setdefault(tuple(w[a : a + 8]), i)
    want = {i: len({p for a in range(len(w) - 7) if first[tuple(w[a : a + 8])] < i for p in range(a, a + 8)}) for i, w in enumerate(words)}
    assert {r.doc_id: r.n_removed for r in dedup_substrings(docs(spark, rows), width=8, gram=3).collect()} == want


def test_link_graph_matches_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.org" for i in range(20)] + ["bad.net", "worse.net"]
    out = {h: [o for o in rng.sample(hosts, rng.randint(0, 4)) if o != h] for h in hosts}
    out["h1.org"] = ["bad.net"]
    path = lambda h: "/fr/" if h in ("h3.org", "h4.org") else "/x"
    rows = [(n, f"https://{h.upper()}{path(h)}", "".join(f'<a href="//{o}/p">' if n % 2 else f"<a HREF='http://{o}?q'>" for o in out[h]) + '<a href="/own">', "clash", 0.5) for n, h in enumerate(hosts)]
    rows += [(90, None, '<a href="http://h1.org/">', "clash", 0.5), (None, "no scheme", None, "clash", 0.5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score double")
    index = {h: i for i, h in enumerate(hosts)}
    ruled = {h: "block" if h.endswith(".net") else "allow" if path(h) == "/fr/" else None for h in hosts}

    def rank(seed, steps):
        score = seed.copy()
        for _ in range(400):
            moved = np.zeros(len(hosts))
            for h, targets in steps.items():
                for t in targets or [h]:
                    moved[index[t]] += score[index[h]] / max(1, len(targets))
            score = 0.15 * seed + 0.85 * moved
        return score

    trust = rank(np.array([float(ruled[h] == "allow") for h in hosts]), out)
    leads = np.array([[(t in out[h]) / max(1, len(out[h])) for t in hosts] for h in hosts])
    distrust = np.linalg.solve(np.eye(len(hosts)) - 0.85 * leads, np.array([float(ruled[h] == "block") for h in hosts]))
    got = {r.page_id: r for r in urlgraph.judge_pages(pages, threshold=0.1).collect()}
    for n, h in enumerate(hosts):
        assert np.allclose((got[n].trust, got[n].distrust), (trust[index[h]], distrust[index[h]]), atol=1e-5)
        assert got[n].verdict == (ruled[h] or ("block" if distrust[index[h]] - trust[index[h]] >= 0.1 else "allow"))
    assert {got[n].verdict for n, h in enumerate(hosts) if ruled[h] is None} == {"allow", "block"}
    assert got[90].host == "" and got[None].verdict == "allow"
    assert urlgraph.judge_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("linkers", [1, 3, 400])
def test_farms_of_any_size_are_judged_by_where_their_links_lead(spark, linkers):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(0, "http://bad.net/", None)] + [(1 + i, f"http://farm{i}.org/", link("bad.net")) for i in range(linkers)]
    rows += [(900, "http://two.steps.org/", link("farm0.org")), (901, "http://portal.org/", link("bad.net", *(f"good{i}.org" for i in range(9)))), (902, "http://plain.org/", None)]
    rows += [(None, "http://farm0.org/again", link("bad.net")), (None, "http://farm0.org/again", link("bad.net"))]
    pages = spark.createDataFrame([(*r, "clash", 1.0, 2.0) for r in rows], "page_id long, url string, html string, host string, trust double, seed double")
    got = [(r.page_id, r.verdict) for r in urlgraph.judge_pages(pages).collect()]
    assert {v for i, v in got if i is not None and 1 <= i <= linkers} == {"block"} and len(got) == len(rows)
    assert {i: v for i, v in got if i is None or i >= 900} == {900: "block", 901: "allow", 902: "allow", None: "block"}


def test_rows_that_repeat_give_each_position_once(spark):
    text = " ".join(f"c{i}" for i in range(60))
    rows = [(1, text + " a")] + [(2, text + " b")] * 300 + [(None, text + " d")] * 300
    got = dedup_substrings(docs(spark, rows)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1), (2, 60, 300), (None, 60, 300)], key=str)


def test_mixed_rows_keep_clashing_columns(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}", 0, "a", "b", "c", "d", "e", 1) for i in range(60)] + [(None, "x y", "en", None, 0, "a", "b", "c", "d", "e", 1)] * 3
    out = mixed_rows(spark.createDataFrame(rows, DOCS))
    assert out.columns == docs(spark, []).columns and {(r.at, r.key, r.row) for r in out.collect()} == {("c", "d", "e")}
    assert mixed_rows(docs(spark, [])).count() == 0 and mixed_rows(docs(spark, [(1, None), (2, "")])).count() == 0


def test_stages_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    body = lambda n=60: " ".join(rng.choices(words, k=n))
    rows, marks = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, body() + (" moronic scummy idiotic" if toxic else ""), "en", f"s{i % 3}", 0))
        marks.append((i, 1, int(toxic)))
    clean = body(80)
    rows += [(1000, clean, "en", "s0", 0), (1001, clean + " end", "en", "s1", 0), (1002, "mail me at a.b@c.dd please", "en", None, 0), (1003, None, None, None, None), (1004, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "best_fit_packing":
            assert frame.columns == [f.split()[0] for f in schema.split(", ")]
        seen[name] = frame = saved(frame, "stage")
    ids = {n: sorted(r.doc_id for r in f.collect()) for n, f in seen.items()}
    assert ids["toxicity"] == [i for i, *_ in rows if not (i < 300 and i % 5 == 0)]
    assert ids["minhash_near_dedup"] == [i for i in ids["toxicity"] if i != 1001]
    texts = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert texts[1002] == "mail me at [EMAIL] please" and texts[1] == rows[1][1] and sorted(texts) == ids["minhash_near_dedup"]
    sizes = {i: len((t or "").split()) for i, t in texts.items()}
    mixed = [(i, sizes[i]) for i in ids["source_mix"]]
    assert abs(sum(n for _, n in mixed) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values()) and max(ids["source_mix"].count(i) for i, _ in mixed) <= 2
    packed = {}
    for r in seen["best_fit_packing"].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: n * ids["source_mix"].count(i) for i, n in set(mixed) if n}
    assert cp.run(spark, str(tmp_path)).count() == seen["best_fit_packing"].count()
