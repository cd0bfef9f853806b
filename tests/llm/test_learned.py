"""Toxicity from texts to scores, nearest neighbours, fingerprints and packing against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import fingerprint as fp
from skein.llm import packing
from skein.llm import toxicity as tx
from skein.llm.ann import nearest

DOCS = "doc_id long, text string, score double, row_key string, text_key string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, "a", "b", "c") for i, t in rows], DOCS)


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        body = rng.choices(words, k=rng.randint(3, 60)) + (rng.sample(["moronic", "scummy", "idiotic"], 2) if toxic else ["kindly"])
        rng.shuffle(body)
        rows.append((i, " ".join(body)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_scores_match_brute_force_from_texts(spark):
    rows, marks = corpus(160)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scorer = tx.ToxicityScorer(docs(spark, rows), labels, k=7)
    examples = {r.name: (r.text, r.toxic) for r in scorer.sample.filter("not calibrates").collect()}
    bags = {n: Counter(t.split()) for n, (t, _) in examples.items()}
    df = Counter(w for _, t in rows for w in set(t.split()))
    toxic, other = (Counter(w for n, b in bags.items() if examples[n][1] == y for w in b) for y in (1, 0))
    known = toxic.keys() | other.keys()
    weight = lambda w: math.log(1 + len(rows) / df[w]) * math.log2(2 + toxic[w] / max(1, other[w])) if w in known else math.log(1 + len(rows))
    vector = lambda bag: {w: (1 + math.log(n)) * weight(w) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = {n: vector(b) for n, b in bags.items()}
    base = np.mean([y for _, y in examples.values()])
    got = {r.doc_id: r for r in scorer.score().collect()}
    for i, text in rows[::9]:
        v = vector(Counter(text.split()))
        cosines = sorted((sum(x * o.get(w, 0) for w, x in v.items() if w in known) / (norm(v) * norm(o)) for o in vectors.values()), reverse=True)[:7]
        assert np.allclose(got[i].cosines, [c for c in cosines if c > 0])
        ys = [examples[n][1] for n in got[i].evidence]
        prior = got[i].cosines[0] / 10
        assert got[i].score == pytest.approx((np.dot(got[i].cosines, ys) + prior * base) / (sum(got[i].cosines) + prior))


def test_block_max_search_is_exact_with_and_without_head_words():
    rng = np.random.default_rng(5)
    for share in (0.05, 0.9):
        examples = []
        for name in range(500):
            ids = np.unique(np.minimum(rng.geometric(0.05, rng.integers(1, 30)), 79))
            w = rng.uniform(0.1, 1, len(ids))
            examples.append((name, float(name % 3 == 0), ids, w / np.sqrt((w * w).sum())))
        columns = zip(*examples, strict=True)
        table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)], ["name", "toxic", "ids", "weights"])
        index = tx.Index.build(table, 80, share)
        dense = np.zeros((500, 80))
        for name, _, ids, w in examples:
            dense[name, ids] = w
        for _ in range(40):
            ids = np.unique(np.minimum(rng.geometric(0.05, 12), 79))
            w = rng.uniform(0, 1, len(ids))
            _, cosines = index.search(ids, w, 9)
            assert np.allclose(cosines, np.sort(dense[:, ids] @ w)[::-1][:9])


def test_held_out_texts_and_dropped_rows(spark):
    rows, marks = corpus(900, 7)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    frame = docs(spark, [*rows, (5000, None), (None, "moronic scummy"), (5001, "zz")])
    truth = {i: y for i, _, y in marks}
    out = tx.score_documents(frame, labels).collect()
    tested = [(r.predicted, truth[r.doc_id]) for r in out if r.doc_id in truth and r.held_out]
    assert len(tested) > 150 and np.mean([p == y for p, y in tested]) > 0.97
    assert {r.doc_id: r.predicted for r in out if r.doc_id not in truth} == {5000: 0, None: 1, 5001: 0}
    kept = tx.drop_toxic(frame, labels)
    assert kept.columns == frame.columns and {(r.score, r.row_key, r.row) for r in kept.collect()} == {(9.0, "a", "c")}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_few_or_no_labels_drop_nothing_clean(spark):
    rows = [(i, t) for i, t in enumerate(["good plain words", "moronic fool", None, "", "unlike them all"])]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.drop_toxic(docs(spark, rows), none).count() == 5
    assert tx.score_documents(docs(spark, rows), none).agg({"score": "max"}).first()[0] == 0
    few = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in tx.drop_toxic(docs(spark, rows), few).collect()} >= {0, 2, 3, 4}
    assert tx.score_documents(docs(spark, []), few).count() == 0


def test_neighbours_at_extreme_scales_and_with_clashing_columns(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((130, 8))
    v[50] *= 1e-200
    v[3] = v[50] * 0.5 + rng.standard_normal(8) * 1e-203
    v[100] *= 1e200
    v[7] = v[100] / 1e300
    rows = [(i, x.tolist(), "c", 1.0) for i, x in enumerate(v)] + [(None, v[1].tolist(), "c", 1.0), (9007199254740993, v[50].tolist(), "c", 1.0), (150, [1.0, None] + [0.0] * 6, "c", 1.0), (200, [1.0, 2.0], "c", 1.0)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id string, score double")).toPandas()
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, unit = np.r_[np.arange(130), 9007199254740993], np.vstack([unit, unit[50]])
    for q in (0, 50, 100):
        score = np.round(unit @ unit[q], 12)
        want = [i for i in ids[np.lexsort((ids, -score))] if i != q][:5]
        assert out[out.query_id == q].sort_values("rank").vec_id.tolist() == want
    assert 200 not in set(out.query_id) and 150 not in set(out.query_id)


def test_likeness_estimates_the_jaccard_share_of_phrases():
    rng = random.Random(6)
    phrases = lambda t: {t[a:b] for a, b in zip([0, *fp.phrase_ends(t, {})], [*fp.phrase_ends(t, {}), len(t)], strict=True) if a < b}
    errors = []
    for _ in range(60):
        a = "".join(rng.choices("abcdef ", k=rng.randint(200, 4000)))
        cut = rng.randint(0, len(a))
        b = a[:cut] + "".join(rng.choices("abcdef ", k=len(a) - cut))
        pa, pb = phrases(a), phrases(b)
        errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(pa & pb) / len(pa | pb))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_of_odd_texts(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=1_000_000))
    rows = [(1, None), (2, ""), (3, long), (9007199254740993, "é" * 9), (None, "x"), (3, long)]
    out = {r.doc_id: r for r in fp.neighbour_likeness(docs(spark, rows)).collect()}
    assert out[1].fingerprint == out[2].fingerprint == "fff" * 128 and out[1].near_next == 1
    assert out[3].n_chars == 1_000_000 and out[9007199254740993].n_chars == 9
    assert fp.neighbour_likeness(docs(spark, [])).count() == 0


def brute_pack(sizes, capacities, quadratic, joint):
    """The documented rule, searched naively: best fit, else the cheapest bin, then downsizing."""
    price = lambda c: c + quadratic * c * c / capacities[-1]
    bins, opened, filled = [], Counter(), Counter()
    for n, size in enumerate(sizes):
        fits = [b for b in bins if b["cap"] - b["used"] >= size]
        if fits:
            best = min(fits, key=lambda b: (b["cap"] - b["used"], b["n"]))
        else:
            expect = lambda c: max(size, filled[c] / opened[c] if opened[c] >= 8 else c)  # noqa: B023, E731
            cap = min((c for c in capacities if c >= size), key=lambda c: (price(c) / expect(c), c)) if joint else capacities[-1]
            best = {"cap": cap, "used": 0, "n": len(bins), "items": []}
            bins.append(best)
            opened[cap] += 1
        filled[best["cap"]] += size
        best["used"] += size
        best["items"].append(n)
    final = [min(c for c in capacities if c >= b["used"]) for b in bins]
    return sum(map(price, final)), [b["items"] for b in bins], final


def test_packing_follows_the_rule_and_keeps_large_ids(spark):
    rng = random.Random(9)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 80))), reverse=True)
        at, _, final = packing.pack_sizes(np.array(sizes), (16, 32, 64), 0.25)
        cost, items, caps = min((brute_pack(sizes, (16, 32, 64), 0.25, j) for j in (True, False)), key=lambda p: p[0])
        assert [np.flatnonzero(at == b).tolist() for b in range(len(final))] == items and final.tolist() == caps
    rows = [(9007199254740993, "a b c"), (None, "d e"), (None, None), (2**63 - 1, "f"), (4, "")]
    out = packing.pack_documents(docs(spark, rows)).collect()
    assert {(r.doc_id, r.length) for r in out} == {(9007199254740993, 3), (None, 2), (2**63 - 1, 1)}
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_unrelated_long_texts_are_not_alike():
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(lo, lo + 60, 4_000_000))) for lo in (0x61, 0x400)]
    a, b = map(fp.fingerprint, texts)
    assert fp.likeness(a, b) < 0.02 and fp.likeness(a, a) == 1.0


def test_floating_minima_keep_order_and_width():
    values = np.unique(np.r_[np.arange(600), 1 << np.arange(40), (1 << np.arange(1, 40)) - 1]).astype(np.uint64)
    codes = fp.floating(values).astype(int)
    assert (np.diff(codes >> fp.DIGITS) <= 0).all() and codes.max() < fp.NONE and codes.min() >= 0
