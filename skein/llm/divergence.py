"""Divergence of each source from the others of its language and from the language: upper-bound term search.

Terms are runs of ASCII letters and of all that is not ASCII, with A-Z lower-cased. A language keeps the terms of at least
``least`` of its documents. Each group (lang, source) and each language gives a kept term with ``n`` occurrences there

    p = 1 + floor(10 ** 9 * (n + 5) / (N + 5 * V)),

N its occurrences of kept terms, V the language's kept terms; all in whole numbers (exact while N + 5 * V < 2.8 * 10 ** 14).

* Part ``pair``: sum of abs(p - q) over the kept terms for every other source of the language, q being its p. Sums are taken
  from postings: V * abs(p0 - q0), of what absent terms have, and for each term that one of both holds its difference from
  that. Postings meet by slots of about ``SLOT`` terms and by pairs of blocks of ``BLOCK`` sources, so that no matrix grows
  with the table and no pair of postings is a row.
* Part ``term``: the ``k`` terms of greatest p - q > 0, q being the language's p. A group's postings lie in buckets of like n.
  A bucket's greatest p less its least q bounds its terms. Buckets are evaluated best bound first: those that together hold k
  postings, which gives a k-th value, then all whose bound is not strictly below that.

Plan: texts are counted where they are read, in combiners of bounded size, so that one row for a group and term leaves each; these
are shuffled once, by lang and term, for counts, document frequencies and postings. Groups (one row a source) and buckets (at
most 500 a group) meet the postings by joins whose way Spark chooses by their size. Ranks are cut before they are shuffled.

Defined cases: null text, lang and source are ''; a group without terms has N = 0 and stands in all pairs; where V = 0 every
pair has value 0; repeated rows count each; an empty table gives an empty result; other columns, and doc_id, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import saved

ENTRIES = 500_000  # (group, term) that a combiner holds
SLOT = 2048  # kept terms that meet in one task, about
BLOCK = 128  # sources
GROUP = ["lang", "source"]
# bytes of terms, A-Z lower-cased; all others part them
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return (text or "").encode().translate(_TERM_BYTES).split(b" ")


def _counted(batches):
    """Rows (lang, source, term, n, docs) of the batches' texts."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flushed():
        for (lang, source), (times, docs) in held.items():
            terms = list(times)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        entries = sum(len(times) for times, _ in held.values())
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            terms = terms_of(text.as_py())
            times, docs = held[lang.as_py(), source.as_py()]
            entries -= len(times)
            times.update(terms)
            docs.update(set(terms))
            del times[b""], docs[b""]
            entries += len(times)
            if entries >= ENTRIES:
                yield from flushed()
                entries = 0
    yield from flushed()


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(10 ** 9 * (n + 5) / (total + 5 * kept)) in whole numbers of 64 bits; 10 ** 9 is 31,250 times 32,000."""
    top, below = f"(({n} + 5L) * 31250L)", f"greatest({total} + 5L * {kept}, 1L)"
    return F.expr(f"1L + ({top} div {below}) * 32000L + (({top} % {below}) * 32000L) div {below}")


def _probabilities(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    top, below = (n + 5) * 31_250, np.maximum(total + 5 * kept, 1)
    return 1 + top // below * 32_000 + top % below * 32_000 // below


class Audit:
    """Counts of one table of documents: ``postings`` of kept terms and ``groups``.

    ``slot`` and ``block`` bound what meets in one task of ``pairs``: about ``slot`` terms of two blocks of sources.
    """

    def __init__(self, docs: DataFrame, least: int = 30, slot: int = SLOT, block: int = BLOCK):
        self.slot, self.block = slot, block
        named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")))
        counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
        postings = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        postings = postings.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
        self.postings = saved(postings.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).cast("long").alias("first")), "postings")
        sums = self.postings.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        langs = self.postings.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
        groups = named.select(*GROUP).distinct().join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0)
        # sources are numbered within their language, for blocks
        self.groups = saved(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")

    def terms(self, k: int = 50) -> DataFrame:
        """lang, source, item, value, rank of part ``term``."""
        rows = self.postings.join(self.groups.select(*GROUP, "total", "kept", "lang_total"), GROUP)
        digits = F.length(F.bin("n"))
        bucket = digits * 8 + F.expr("shiftright(n, greatest(length(bin(n)) - 4, 0)) & 7")
        rows = rows.withColumn("bucket", bucket)
        sizes = ("total", "kept", "lang_total")
        buckets = rows.groupBy(*GROUP, "bucket").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("most"), F.min("lang_n").alias("rarest"), *(F.first(c).alias(c) for c in sizes))
        buckets = buckets.select(*GROUP, "bucket", "held", (probability("most", "total", "kept") - probability("rarest", "lang_total", "kept")).alias("bound")).filter("bound > 0")
        best_first = Window.partitionBy(*GROUP).orderBy(F.col("bound").desc(), "bucket")
        buckets = saved(buckets.withColumn("ahead", F.sum("held").over(best_first) - F.col("held")), "buckets")
        value = probability("n", "total", "kept") - probability("lang_n", "lang_total", "kept")
        order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")

        def best(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        def evaluated(some: DataFrame) -> DataFrame:
            return best(rows.join(some.select(*GROUP, "bucket"), [*GROUP, "bucket"]).select(*GROUP, F.col("term").alias("item"), value.alias("value")).filter("value > 0"))

        seen = saved(evaluated(buckets.filter(F.col("ahead") < k)), "seen-terms")
        kth = seen.filter(F.col("rank") == k).select(*GROUP, F.col("value").alias("kth"))
        open_ = buckets.filter(F.col("ahead") >= k).join(kth, GROUP, "left").filter(F.col("bound") >= F.coalesce("kth", F.lit(1)))
        return best(seen.drop("rank").unionByName(evaluated(open_).drop("rank")))

    def pairs(self) -> DataFrame:
        """lang, source, item, value of part ``pair``."""
        block, blocks = F.floor(F.col("number") / self.block).cast("int"), F.ceil(F.col("sources") / self.block).cast("int")
        slots = F.ceil(F.col("kept") / self.slot)
        others = F.explode(F.sequence(F.lit(0), blocks - 1))
        cell = ["lang", "slot", "low", "high"]

        def in_cells(rows: DataFrame, *columns) -> DataFrame:
            named = [F.col(c).alias(c) for c in ("lang", "slot", "number", "total", "kept", *columns)]  # both sides come from groups
            return rows.withColumn("other", others).select(*named, F.least(block, "other").alias("low"), F.greatest(block, "other").alias("high"))

        postings = self.postings.join(self.groups, GROUP).withColumn("slot", F.pmod(F.xxhash64("term"), slots))
        left = in_cells(postings, "term", "n")
        right = in_cells(self.groups.filter("kept > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slots.cast("long") - 1))))
        size = self.block

        def differences(key, left, right):
            return _differences(key, left, right, size)

        part = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(differences, "lang string, a int, b int, part long")
        sums = part.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
        absent = probability("0L", "total", "kept")
        own = self.groups.select("lang", "source", "kept", F.col("number").alias("na"), absent.alias("pa"))
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("number").alias("nb"), absent.alias("pb"))
        both = own.join(other, "lang").filter("na <> nb").withColumns({"a": F.least("na", "nb"), "b": F.greatest("na", "nb")}).join(sums, ["lang", "a", "b"], "left")
        value = F.when(F.col("kept") > 0, F.col("kept") * F.abs(F.col("pa") - F.col("pb")) + F.coalesce("part", F.lit(0))).otherwise(F.lit(0))
        return both.select("lang", "source", "item", value.cast("long").alias("value"))


def _differences(key: tuple, postings: pd.DataFrame, groups: pd.DataFrame, block: int) -> pd.DataFrame:
    """For each pair of sources of a cell: sum over the cell's terms of what their difference exceeds that of absent terms by."""
    lang, _, low, high = key
    groups = groups.sort_values("number")
    numbers, total, kept = groups["number"].to_numpy(), groups["total"].to_numpy(), int(groups["kept"].iloc[0])
    absent = _probabilities(np.zeros(len(numbers), np.int64), total, kept)
    terms, distinct = pd.factorize(postings["term"])
    at = np.searchsorted(numbers, postings["number"].to_numpy())
    table = np.tile(absent[:, None], (1, len(distinct)))
    table[at, terms] = _probabilities(postings["n"].to_numpy(), total[at], kept)
    mine = np.flatnonzero(numbers // block == low)
    theirs = np.flatnonzero(numbers // block == high)
    found = []
    for a in mine:
        b = theirs[theirs > a]
        part = np.abs(table[b] - table[a]).sum(1) - len(distinct) * np.abs(absent[b] - absent[a])
        found.append(pd.DataFrame({"lang": lang, "a": numbers[a], "b": numbers[b], "part": part}))
    out = pd.concat(found) if found else pd.DataFrame({"lang": [], "a": [], "b": [], "part": []})
    return out.astype({"a": "int32", "b": "int32", "part": "int64"})


def divergence(docs: DataFrame, least: int = 30, k: int = 50, slot: int = SLOT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of both parts."""
    audit = Audit(docs, least, slot, block)
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    columns = lambda part: (*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return pairs.select(*columns("pair")).unionByName(audit.terms(k).select(*columns("term")))
