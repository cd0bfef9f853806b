"""DuckDB SQL for those corpus queries that SQL can express; it runs over the same Parquet tables."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(generate_series(win.i, win.i + 49)) AS p FROM win JOIN first USING (g) WHERE win.doc_id > first.lo)),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN d.w ELSE [x.v FOR x IN list_transform(d.w, lambda v, i: {{'v': v, 'i': i}}) IF NOT list_contains(ps, x.i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / weight, turn)) FROM l WHERE level * weight <= cap) * weight, cap)) AS target,
        CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source_key FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS expected, ('0x' || md5('mix-1' || source_key)[1:8])::BIGINT / 4294967296.0::DOUBLE AS off FROM t),
r AS (SELECT d.*, e.* EXCLUDE (source), lpad(len(bin(size))::VARCHAR, 2, '0') || rpad(bin(size)[2:4], 3, '0') AS cls, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % 256 AS bucket
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY cls, bucket, size, doc_id) AS place FROM r)
SELECT doc_id, size, source_size, target, ((floor(place * expected + off) - floor((place - 1) * expected + off)) * size)::BIGINT AS taken FROM p
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
steps AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT u AS doc_id, u AS r FROM steps UNION SELECT reach.doc_id, steps.v FROM reach JOIN steps ON steps.u = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


def op10(rules, rounds: int = 60, damping: float = 0.85, threshold: float = 0.5) -> str:
    """Propagation unrolled far enough that less than 0.85 ** 60 = 0.00006 of the seeds can still move."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    steps = ",\n".join(
        f"r{k} AS MATERIALIZED (SELECT s.kind, s.host, s.seed, s.ends, CASE s.kind WHEN 'trust' THEN {1 - damping!r}::DOUBLE * s.seed + {damping!r}::DOUBLE * (coalesce(g.got, 0) + CASE WHEN s.ends THEN s.score ELSE 0 END) ELSE s.seed + {damping!r}::DOUBLE * coalesce(g.got, 0) END AS score "
        f"FROM r{k - 1} s LEFT JOIN (SELECT st.kind, st.dst AS host, sum(p.score * st.weight) AS got FROM st JOIN r{k - 1} p ON p.kind = st.kind AND p.host = st.src GROUP BY ALL) g ON g.kind = s.kind AND g.host = s.host)"
        for k in range(1, rounds + 1)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
j AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM h),
e AS MATERIALIZED (SELECT DISTINCT host AS src, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)) AS t FROM j) WHERE host <> '' AND host <> translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
dg AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY src),
st AS MATERIALIZED (SELECT 'trust' AS kind, e.src, e.dst, 1.0::DOUBLE / degree AS weight FROM e JOIN dg USING (src) UNION ALL SELECT 'distrust', e.dst, e.src, 1.0::DOUBLE / degree FROM e JOIN dg USING (src)),
own AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS allowed, count(*) FILTER (ruled = 'block') / count(*) AS blocked FROM j GROUP BY host),
seen AS (SELECT host, max(allowed) AS allowed, max(blocked) AS blocked FROM (SELECT * FROM own UNION ALL SELECT dst, 0, 0 FROM e) GROUP BY host),
sd AS (SELECT 'trust' AS kind, host, allowed::DOUBLE AS seed FROM seen UNION ALL SELECT 'distrust', host, blocked::DOUBLE FROM seen),
r0 AS MATERIALIZED (SELECT sd.kind, sd.host, sd.seed, dg.degree IS NULL AS ends, sd.seed AS score FROM sd LEFT JOIN dg ON dg.src = sd.host),
{steps},
ph AS (SELECT host, max(CASE WHEN kind = 'trust' THEN score END) AS trust, max(CASE WHEN kind = 'distrust' THEN score END) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust - trust >= {threshold!r} THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN ph USING (host)
"""


def _cut(text: str, patterns: dict[str, str]) -> str:
    """Columns m_<kind> (matches) and g_<kind> (gaps between them)."""
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    return ", ".join(f"regexp_extract_all({text}, '{p}') AS m_{k}, string_split_regex({text}, '{p}') AS g_{k}" for k, p in quoted.items())


def _spans(kind: str, keep: str, name: str = "") -> str:
    """List of {start, kind, value} of the matches of a cut for which ``keep`` holds (of x.value)."""
    m, g = f"m_{name or kind}", f"g_{name or kind}"
    return rf"""list_filter(list_transform({m}, lambda m, i: {{
      'start': (list_sum(list_transform({g}[:i], lambda g: length(g))) + coalesce(list_sum(list_transform({m}[:i - 1], lambda g: length(g))), 0))::BIGINT,
      'kind': '{kind}', 'value': m}}), lambda x: {keep})"""


def _digest(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda s: s.kind || ':' || s.start || ':' || (s.start + length(s.value))), ',')"


def _ordered(spans: str, kinds) -> str:
    """Spans by start, then kind as listed, then end."""
    order = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return f"list_transform(list_sort(list_transform({spans}, lambda s: {{'a': s.start, 'b': list_position({order}, s.kind), 'c': length(s.value), 's': s}})), lambda r: r.s)"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"
_PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.value, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
b0 AS (SELECT doc_id, text, rid, {" || ".join(_spans(k, keep) for k, (_, keep) in _PRIVATE.items())} AS raw FROM (SELECT *, {_cut("text", {k: p for k, (p, _) in _PRIVATE.items()})} FROM d)),
b AS (SELECT doc_id, text, rid, {_ordered("raw", (*_PRIVATE, "term", "name"))} AS base FROM b0),
o AS (SELECT rid, text, CASE WHEN len(base) = 0 THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c, i: CASE WHEN len(list_filter(base, lambda x: x.start < i AND i <= x.start + length(x.value))) > 0 THEN '0' ELSE c END), '') END AS outside FROM b),
e AS (SELECT DISTINCT rid, text, CASE s.kind WHEN 'email' THEN 'email:' || lower(s.value) ELSE s.kind || ':' || regexp_replace(s.value, '[^0-9]', '', 'g') END AS entity FROM (SELECT rid, text, unnest(base) AS s FROM b)),
ne AS (SELECT entity, count(*) AS n_e FROM e GROUP BY ALL HAVING count(DISTINCT text) >= 3),
t AS (SELECT DISTINCT rid, lower(unnest(regexp_extract_all(outside, '[\p{{L}}\p{{M}}]{{3,}}'))) AS term FROM o),
nt AS (SELECT term, count(*) AS n_t FROM t GROUP BY ALL),
p AS (SELECT entity, n_e, term, count(*) AS n_et FROM e JOIN ne USING (entity) JOIN t USING (rid) GROUP BY ALL HAVING count(DISTINCT text) >= 3),
f AS (SELECT term, max(log2(n::DOUBLE * n_et / (n_e::DOUBLE * n_t)) / log2(n::DOUBLE / n_e)) AS disclosure FROM p JOIN nt USING (term) CROSS JOIN (SELECT count(*) AS n FROM d) WHERE n > n_e GROUP BY term HAVING disclosure >= 0.9),
w AS (SELECT rid, u.start AS start, u.value AS value FROM (SELECT rid, unnest({_spans("term", "true", "o")}) AS u FROM (SELECT rid, {_cut("outside", {"o": r"[\p{L}\p{M}]{3,}"})} FROM o WHERE rid IN (SELECT rid FROM t JOIN f USING (term))))),
h AS (SELECT rid, list({{'start': start, 'kind': CASE WHEN disclosure >= 0.98 THEN 'term' ELSE 'name' END, 'value': value}}) AS terms FROM w JOIN f ON term = lower(value) GROUP BY rid)
SELECT doc_id, {", ".join(f"len(list_filter(base, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k in _PRIVATE)}, coalesce(len(terms), 0)::BIGINT AS n_term,
  sha256({_digest("base")}) AS base_sha256, {_digest(_ordered("base || coalesce(terms, [])", (*_PRIVATE, "term", "name")))} AS spans
FROM b LEFT JOIN h USING (rid)
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM (SELECT vec_id, embedding, embedding::DOUBLE[] AS v FROM embeddings) WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT DISTINCT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (q.norm * c.norm) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""


def op9(rules, base) -> str:
    keep = lambda r: "true" if not r.least else f"length(regexp_extract(x.value, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least}"
    kinds = [r.kind for r in rules]
    # runs of one class: shorter ones never pass, so they need not be cut out
    patterns = {r.kind: f"{r.pattern[:-1]}{{{r.least},}}" if r.pattern.count("[") == 1 and r.pattern.startswith("[") else r.pattern for r in rules}
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k in base)
    only = f"list_filter(spans, lambda s: s.kind IN ({', '.join(repr(k) for k in base)}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, {_cut("text", patterns)} FROM d),
s AS (SELECT doc_id, {_ordered("raw", kinds)} AS spans FROM (SELECT doc_id, {" || ".join(_spans(r.kind, keep(r)) for r in rules)} AS raw FROM c))
SELECT doc_id, {counts}, sha256({_digest(only)}) AS base_sha256, {_digest("spans")} AS spans FROM s
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
named AS (SELECT conv_id, turn, coalesce('=' || conv_id, '') AS g, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, tab),
damaged AS (
  SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
r AS (
  SELECT *, left(role, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before FROM lined),
n AS (SELECT g, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g),
gap(s, t, c, a, m) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'),
        (2, 3, 3, 'I', chr(10) || 'assistant:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
move(s, t, a, c, initial, role) AS (VALUES (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL),
        (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'), (3, 2, 'R', 3, NULL, 'user'),
        (0, 0, 'D', 4, NULL, NULL), (1, 1, 'D', 4, NULL, NULL), (2, 2, 'D', 4, NULL, NULL), (3, 3, 'D', 4, NULL, NULL)),
step AS (
    SELECT g, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': '', 'm': ''} AS way FROM n
  UNION ALL
    SELECT r.g, r.i, move.t, min({'c': way.c + gap.c + move.c + CASE WHEN fault = 'truncated' AND move.a <> 'D' THEN 3 ELSE 0 END, 'a': way.a || gap.a || move.a,
        'm': way.m || gap.m || CASE move.a WHEN 'D' THEN '' ELSE chr(10) || coalesce(move.role, r.role) || ':' || text END})
    FROM step JOIN r ON r.g = step.g AND r.i = step.i + 1 JOIN gap ON gap.s = step.s JOIN move ON move.s = gap.t
    WHERE (move.a = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (move.a <> 'K' OR move.initial = r.initial)
    GROUP BY r.g, r.i, move.t),
done AS (SELECT step.g, min({'c': way.c + gap.c, 'a': way.a || gap.a, 'm': way.m || gap.m}) AS way FROM step JOIN n ON n.g = step.g AND n.n = step.i JOIN gap ON gap.s = step.s WHERE gap.t IN (0, 3) GROUP BY step.g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(substr(way.m, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM named) LEFT JOIN n USING (g) LEFT JOIN done USING (g)
"""
