"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams: a disjunction of clauses, each a set of trigrams that
every match of that alternative must hold (Cox, 2012). The index holds, for each trigram that some query names, the
documents whose lower-cased text has it. A query's clauses intersect their postings; documents that satisfy a clause are
verified with the rule's expression. Rules without mandatory trigrams scan every document.

Postings are keyed by (document, clause) when they are intersected, by OR of one bit per trigram, so a trigram that a
third of all documents hold is pre-aggregated like any other and no posting list is gathered. The clauses are the only
broadcast table: a few rows per rule.

Defined cases: null text is the empty text; repeated rows (equal doc_id and text) are found alike; a null doc_id is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.spans import count_of, find_spans, in_order, joined, no_spans
from skein.session import saved

MOST_STRINGS = 64  # of one exact set; larger sets are cut into clauses before they grow further


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` bounds the length of capture ``group`` of a match (0: the whole match).

    Patterns repeat single character classes only, never groups, so that matching takes no stack, however long the text.
    ``alone``, a class of characters, says that a match starts a run of these: it is not looked for inside one.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    alone: str = ""


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    # further kinds that the method adds
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, alone="[A-Za-z0-9_-]"),
)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """A disjunction without the clauses that a weaker one implies."""
    return {c for c in clauses if not any(o < c for o in clauses)}


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    return _either({x | y for x, y in product(a, b)})


def _exact(node) -> set[str] | None:
    """The lower-cased strings that one element of a parsed expression matches, where they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(o is not sre.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _exact_run(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_run(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one = _exact_run(arg[2])
        return None if one is None else set().union(*({"".join(p) for p in product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
    return None


def _exact_run(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of mandatory trigrams of a regular expression; None if some match needs none."""

    def of(nodes) -> set[frozenset[str]]:
        clauses, strings = {frozenset()}, {""}
        for node in [*nodes, None]:
            one = None if node is None else _exact(node)
            if one is not None and len(strings) * len(one) <= MOST_STRINGS:
                strings = {a + b for a, b in product(strings, one)}
                continue
            clauses = _both(clauses, _either({_trigrams(s) for s in strings}))
            strings = one if one is not None else {""}
            if one is None and node is not None:
                op, arg = node
                if op is sre.SUBPATTERN:
                    clauses = _both(clauses, of(arg[3]))
                elif op is sre.BRANCH:
                    clauses = _both(clauses, _either(set().union(*(of(p) for p in arg[1]))))
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                    clauses = _both(clauses, of(arg[2]))
        if strings != {""}:
            clauses = _both(clauses, _either({_trigrams(s) for s in strings}))
        return clauses

    clauses = of(sre_parser.parse(pattern))
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def fast(rule: Rule) -> str:
    """The rule's pattern, anchored where a plain run of one class lets long runs be read once."""
    if run := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        return f"(?<!{run[1]}){run[1]}{{{max(rule.least, 1)},}}+"
    return (f"(?<!{rule.alone})" if rule.alone else "") + rule.pattern


def rule_spans(text: Column, rule: Rule) -> Column:
    found = find_spans(text, fast(rule), rule.kind)
    if not rule.least:
        return found
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group) if rule.group else s["value"]) >= rule.least)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row (trigram, row_key, text_key) for each document that holds one of the named trigrams."""
    lowered = texts.select("row_key", "text_key", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return lowered.select("row_key", "text_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Documents that satisfy a rule's query: row_key, text_key, rules."""
    rows = [(rule, number, trigram, bit, 2 ** len(clause) - 1) for rule, clauses in queries.items() for number, clause in enumerate(clauses) for bit, trigram in enumerate(sorted(clause))]
    clauses = index.sparkSession.createDataFrame(rows, "rule string, clause int, trigram string, bit int, full long")
    mask = F.bit_or(F.expr("shiftleft(1L, bit)"))
    met = index.join(F.broadcast(clauses), "trigram").groupBy("row_key", "text_key", "rule", "clause", "full").agg(mask.alias("mask")).filter("mask = full")
    return met.groupBy("row_key", "text_key").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (in order) for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumns({"row_key": F.xxhash64("doc_id", "text"), "text_key": F.xxhash64("text")})
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    kinds = tuple(r.kind for r in rules)
    none = F.array().cast("array<string>")
    if queries:
        index = saved(postings(texts, sorted(set().union(*(c for q in queries.values() for c in q)))), "postings")
        texts = texts.join(candidates(index, queries), ["row_key", "text_key"], "left").withColumn("rules", F.coalesce("rules", none))
    else:
        texts = texts.withColumn("rules", none)
    found = [F.when(F.array_contains("rules", r.kind), rule_spans(F.col("text"), r)).otherwise(no_spans()) if r.kind in queries else rule_spans(F.col("text"), r) for r in rules]
    return texts.select("doc_id", in_order(reduce(F.concat, found), kinds).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(docs, rules).select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
