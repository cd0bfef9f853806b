"""Sanitisation and secrets: co-occurrence against brute force, and texts that are long or full of matches."""

import math
import re
from collections import defaultdict

import pytest

from skein.llm.pii import find_private, sanitise
from skein.llm.secrets import find_secrets

DOCS = "doc_id long, text string, row_key string, text_key string, spans string, row string, n_chars int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", len(t or "")) for i, t in rows], DOCS)


def brute_terms(rows, support=3, generalise=0.9, remove=0.98):
    """Spans of disclosing terms of texts whose only identifiers are emails, by doc_id."""
    mail, letters = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[^\W\d_]{3,}")
    outside = [mail.sub(lambda m: "0" * len(m[0]), t) for _, t in rows]
    has = [{m.lower() for m in mail.findall(t)} for _, t in rows]
    terms = [set(letters.findall(t.lower())) for t in outside]
    n, told = len(rows), defaultdict(float)
    for e in set().union(*has):
        for w in set().union(*terms):
            both = [i for i in range(n) if e in has[i] and w in terms[i]]
            n_e, n_t = sum(e in h for h in has), sum(w in t for t in terms)
            if len({rows[i][1] for i in both}) >= support and len({rows[i][1] for i in range(n) if e in has[i]}) >= support and n_e < n:
                told[w] = max(told[w], math.log2(n * len(both) / (n_e * n_t)) / math.log2(n / n_e))
    kinds = {w: "term" if d >= remove else "name" for w, d in told.items() if d >= generalise}
    return {i: {(kinds[m[0].lower()], m.start(), m.end()) for m in letters.finditer(o) if m[0].lower() in kinds} for (i, _), o in zip(rows, outside, strict=True)}


def letters_of(n):
    return [(i, f"letter {chr(97 + i) * 4} " + "and so on and on as ever " * 20 + "regards Zorblax zor@mail.example.com of Quuxtown") for i in range(n)]


def test_terms_far_away_and_without_the_entity_are_found_as_by_brute_force(spark):
    rows = [(i, "Zorblax " + "filler words go on " * 40 + f"{t} Zorblax") for i, t in letters_of(4)]
    rows += [(50, "Zorblax without any address"), (51, "QUUXTOWN and so on"), *((100 + i, "and so on as ever letter regards of filler words go " + chr(97 + i % 26) * 5) for i in range(400))]
    want = brute_terms(rows)
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("term", "name")} for r in find_private(docs(spark, rows)).collect()}
    assert got == want
    assert want[50] and want[51] and len(want[0]) == 4 and not want[100]
    clean = {r.doc_id: r.text for r in sanitise(docs(spark, rows)).collect()}
    assert all("blax" not in t.lower() for t in clean.values()) and clean[100] == dict(rows)[100]


def test_words_are_lower_cased_by_themselves_and_keep_their_marks(spark):
    marked = "नमस्ते"
    rows = [(i, f"{chr(97 + i) * 4} İSTANBULLU ΑΒΣ.Γ {marked} zor@mail.example.com") for i in range(4)] + [(50, "İSTANBULLU alone"), (51, "αβς alone")]
    rows += [(100 + i, "and so on as ever " + chr(97 + i % 26) * 5) for i in range(300)]
    found = find_private(docs(spark, rows)).filter("doc_id < 100").collect()
    told = {r.doc_id: {dict(rows)[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("term", "name")} for r in found}
    assert told[0] == {"İSTANBULLU", "ΑΒΣ", marked} and told[50] == {"İSTANBULLU"} and told[51] == {"αβς"}


def test_exact_copies_of_one_text_disclose_nothing(spark):
    rows = [(i, letters_of(1)[0][1]) for i in range(5)] + [(100 + i, f"and so on {i}") for i in range(30)]
    assert all("term" not in r.spans and "name" not in r.spans for r in find_private(docs(spark, rows)).collect())


def test_columns_keep_names_that_clash_and_repeated_rows_share(spark):
    rows = [(1, "to a@b.cc"), (1, "to a@b.cc"), (None, "to a@b.cc"), (2, None), (3, "")]
    out = sanitise(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted((r.text, r.row_key, r.text_key, r.spans, r.row) for r in out.filter("text like 'to%'").collect()) == [("to [EMAIL]", "a", "b", "c", "d")] * 3
    assert {r.doc_id: r.text for r in out.filter("doc_id > 1").collect()} == {2: None, 3: ""}
    assert sanitise(docs(spark, [])).count() == find_private(docs(spark, [])).count() == 0


def test_texts_of_ten_megabytes_end_in_seconds(spark):
    ips = " ".join(f"10.{i % 200}.{i // 200 % 200}.7" for i in range(100_000))
    hexes = " ".join(f"{i:016x}" for i in range(100_000))
    pem = "-----BEGIN " + "A " * 1_000_000 + "PRIVATE KEY-----"
    rows = [(1, ips), (2, hexes), (3, pem), (4, "eyJ" * 1_000_000), (5, "x" * 10_000_000), (6, "é@" * 1_000_000)]
    secret = {r.doc_id: r for r in find_secrets(docs(spark, rows).select("doc_id", "text")).collect()}
    assert secret[2].n_hex == 100_000 and secret[2].spans.split(",")[-1] == f"hex:{len(hexes) - 16}:{len(hexes)}"
    assert secret[3].spans == f"pem:0:{len(pem)}" and secret[4].spans == ""
    private = {r.doc_id: r for r in find_private(docs(spark, rows[:1] + rows[4:]).select("doc_id", "text")).collect()}
    at = [m.span() for m in re.finditer(r"[0-9.]+", ips)]
    assert private[1].n_ip == 100_000 and private[1].spans == ",".join(f"ip:{a}:{b}" for a, b in at)
    clean = {r.doc_id: r.text for r in sanitise(docs(spark, rows[:1] + rows[4:5])).collect()}
    assert clean[1] == " ".join(["[IP]"] * 100_000) and clean[5] == rows[4][1]


@pytest.mark.parametrize("text", ["a@b.cc" * 3, "1.2.3.4.5.6.7.8", "+1 234 567 890 1 2 3 4.5.6.7", "4111 1111 1111 1111 +49 4111111111111111"])
def test_overlapping_kinds_are_rewritten_once(spark, text):
    row = find_private(docs(spark, [(1, text)])).first()
    clean, upto = "", 0
    for kind, a, b in (s.split(":") for s in row.spans.split(",") if s):
        if int(a) >= upto:
            clean += text[upto : int(a)] + f"[{kind.upper()}]"
        upto = max(upto, int(b))
    assert sanitise(docs(spark, [(1, text)])).first().text == clean + text[upto:]
