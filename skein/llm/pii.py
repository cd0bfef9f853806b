"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the values of formal identifiers (email, ip, card, phone). Terms (runs of three or more letters and
their combining marks, each lower-cased by itself, outside identifiers) are tested for what their presence in a document discloses about an entity in it:

    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t))),    disclosure(e, t) = PMI(e, t) / IC(e),    IC(e) = log2(N / n(e))

N, n(e), n(t) and n(e, t) count documents: all, those with the entity, with the term, with both. A pair needs ``support``
documents of different text, so copying one document does not make its words disclosive. Terms whose disclosure of some
entity reaches ``generalise`` are replaced by a hypernym of their shape, from ``remove`` on they are removed, wherever they
stand in the corpus: a term that tells of an entity does so in documents that do not name it as well.

Plan: entities are counted first, and only those of ``support`` different texts can make a pair. Document frequencies of all
terms are counted over the whole corpus by 64-bit term hash, pre-aggregated. As n(e, t) <= n(e), a pair can reach the
threshold only if n(t) <= N * (n(e) / N) ** generalise, so pairs are made of rare terms alone. Entities that occur in the
very same documents share all counts and are one class, and so are terms: a passage that several documents repeat gives
one pair of classes, however many entities and terms it holds. Pairs are pre-aggregated by class; documents are met by their
key. Nothing is broadcast by hand, and no group is gathered but the spans of one text.

Defined cases: null text is the empty text; rows with a null doc_id are rows like any other; repeated rows (equal doc_id
and text) each count and share their spans; an empty table gives an empty result; other columns are ignored by
``find_private`` and kept by ``sanitise``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.spans import count_of, find_spans, in_order, joined, masked, no_spans, rewritten
from skein.session import saved

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term", "name")  # term: removed; name: generalised
# The contract's patterns with anchors and possessive quantifiers added: the same matches in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
TERM = r"[\p{L}\p{M}]{3,}"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the four formal kinds, in order."""
    email = F.when(text.contains("@"), find_spans(text, EMAIL, "email")).otherwise(no_spans())
    ip = F.filter(find_spans(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(IP_PART)))
    card = F.filter(find_spans(text, CARD, "card"), lambda s: luhn(digits_of(s["value"])))
    phone = F.filter(find_spans(text, PHONE, "phone"), lambda s: F.length(digits_of(s["value"])).between(9, 15))
    phone = F.when(text.contains("+"), phone).otherwise(no_spans())
    return in_order(F.concat(email, ip, card, phone), KINDS)


def entity_of(span: Column) -> Column:
    """What a span names: its kind and its value without regard to case and punctuation."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(digits_of(span["value"])))


def row_keys() -> list[Column]:
    """A row's identity: equal for rows with equal doc_id and text; and the text's."""
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64("text").alias("text_key")]


def without_base(texts: DataFrame) -> DataFrame:
    """Adds ``outside``: the text with its formal identifiers masked."""
    return texts.withColumn("base", base_spans(F.col("text"))).withColumn("outside", masked(F.col("text"), F.col("base"))).drop("base")


def held_by() -> list[Column]:
    """Count of the rows of a group, and two sums of their keys' halves that tell sets of rows apart."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("row_key").bitwiseAND(F.lit(2**32 - 1))).alias("low"), F.sum(F.shiftrightunsigned("row_key", 32)).alias("high")]


class Sanitiser:
    """Spans of one table of documents; ``found`` has a row for each row of the table."""

    def __init__(self, docs: DataFrame, support: int = 3, generalise: float = 0.9, remove: float = 0.98):
        if not 0 < generalise <= remove:
            raise ValueError("generalise must be positive and at most remove")
        self.support, self.generalise, self.remove = support, generalise, remove
        self.texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *row_keys(), "text")
        self.base = saved(self.texts.select("doc_id", "row_key", "text_key", base_spans(F.col("text")).alias("base")), "private")
        self.total = self.base.count()

    def terms(self, texts: DataFrame) -> DataFrame:
        """Distinct terms of each row of texts: row_key, text_key, term_hash."""
        words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("outside", F.lit(TERM), F.lit(0))), F.lower))
        return without_base(texts).select("row_key", "text_key", F.explode(words).alias("term")).select("row_key", "text_key", F.xxhash64("term").alias("term_hash"))

    def entities(self) -> DataFrame:
        """Rows of the entities that can make a pair, by class: row_key, text_key, entity_class, n_e, m (rows of that key)."""
        named = self.base.filter(F.size("base") > 0).select("row_key", "text_key", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity"))
        texts = named.select("entity", "text_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= self.support).select("entity")
        kept = named.groupBy("entity").agg(*held_by()).join(texts, "entity").filter(F.col("n") < self.total)
        of_class = kept.groupBy("n", "low", "high").agg(F.min("entity").alias("entity")).withColumnRenamed("n", "n_e")
        rows = named.join(of_class.select("entity", "n_e"), "entity").groupBy("row_key", "text_key", F.col("entity").alias("entity_class"), "n_e").agg(F.count(F.lit(1)).alias("m"))
        return saved(rows, "entities")

    def disclosing(self) -> DataFrame | None:
        """Terms that disclose an entity, with their greatest disclosure: term_hash, disclosure. None if no entity can make a pair."""
        rows = self.entities()
        widest = rows.agg(F.max("n_e")).first()[0]
        if widest is None:
            return None
        total = F.lit(float(max(self.total, 1)))
        limit = lambda n_e: total * F.pow(n_e / total, F.lit(self.generalise)) * (1 + 1e-9)
        # terms of the texts that name such an entity, each row of equal texts and ids once
        met = self.texts.join(rows.select(F.col("row_key").alias("with_key")).distinct(), F.col("row_key") == F.col("with_key"), "left_semi").dropDuplicates(["row_key"])
        counts = self.terms(self.texts).groupBy("term_hash").agg(*held_by()).withColumnRenamed("n", "n_t").filter((F.col("n_t") >= self.support) & (F.col("n_t") <= limit(F.lit(widest))))
        own = saved(self.terms(met).select("row_key", "term_hash").join(counts, "term_hash"), "own-terms")
        named = own.groupBy("n_t", "low", "high").agg(F.min("term_hash").alias("term_class"))
        classes = own.select("term_hash", "n_t", "low", "high").distinct().join(named, ["n_t", "low", "high"]).select("term_hash", "term_class")
        pairs = own.join(named.select(F.col("term_class").alias("term_hash")), "term_hash", "left_semi").join(rows, "row_key").filter(F.col("n_t") <= limit(F.col("n_e")))
        by_text = pairs.groupBy("entity_class", "term_hash", "n_e", "n_t", "text_key").agg(F.sum("m").alias("m"))
        counted = by_text.groupBy("entity_class", "term_hash", "n_e", "n_t").agg(F.sum("m").alias("n_et"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= self.support)
        pmi = F.log2(total * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
        told = counted.groupBy(F.col("term_hash").alias("term_class")).agg(F.max(pmi / F.log2(total / F.col("n_e"))).alias("disclosure")).filter(F.col("disclosure") >= self.generalise)
        return saved(classes.join(told, "term_class").select("term_hash", "disclosure"), "disclosing")

    def found(self) -> DataFrame:
        """doc_id, row_key, text_key, base, spans (base and disclosing terms, in order)."""
        disclosing = self.disclosing()
        if disclosing is None or disclosing.isEmpty():  # no term to look for
            return self.base.select("doc_id", "row_key", "text_key", "base", F.col("base").alias("spans"))
        told = saved(self.terms(self.texts).select("row_key", "term_hash").join(disclosing, "term_hash").dropDuplicates(["row_key", "term_hash"]), "told")
        removed = F.col("disclosure") >= self.remove
        lists = told.groupBy("row_key").agg(F.collect_list(F.when(removed, F.col("term_hash"))).alias("gone"), F.collect_list(F.when(~removed, F.col("term_hash"))).alias("vague"))
        # the rows to look in grow with the corpus, so texts meet them by a shuffle at every size
        spans = without_base(self.texts.join(lists.hint("merge"), "row_key").dropDuplicates(["row_key"])).select("row_key", "gone", "vague", find_spans(F.col("outside"), TERM, "term").alias("words"))

        def own(terms: str, kind: str) -> Column:
            mine = F.filter("words", lambda s: F.array_contains(terms, F.xxhash64(F.lower(s["value"]))))
            return F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

        terms = spans.select("row_key", F.concat(own("gone", "term"), own("vague", "name")).alias("terms"))
        return self.base.join(terms, "row_key", "left").select("doc_id", "row_key", "text_key", "base", in_order(F.concat("base", F.coalesce("terms", no_spans())), KINDS).alias("spans"))


def find_private(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, one row per document."""
    found = Sanitiser(docs, **options).found()
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    terms = (F.size("spans") - F.size("base")).cast("long").alias("n_term")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), terms)


def hypernym(value: Column) -> Column:
    """What a generalised term becomes: the class of its shape."""
    return F.when(value == F.upper(value), F.lit("[ACRONYM]")).when(F.substring(value, 1, 1) != F.lower(F.substring(value, 1, 1)), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with texts sanitised: base spans become [EMAIL] and so on, disclosing terms go or are generalised.

    Columns stay; n_chars, where present, is counted again. A null text stays null.
    """
    found = Sanitiser(docs, **options).found().filter(F.size("spans") > 0).select("row_key", "text_key", "spans").dropDuplicates(["row_key", "text_key"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row is nested, so that no column of it can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id"), text).alias("row_key"), F.xxhash64(text).alias("text_key")).join(found, ["row_key", "text_key"], "left")

    def replacement(s: Column) -> Column:
        return F.when(s["kind"] == "term", F.lit("")).when(s["kind"] == "name", hypernym(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    old = F.col("row.text").cast("string")
    clean = keyed.withColumn("clean", F.when(F.col("spans").isNull(), old).otherwise(rewritten(old, F.col("spans"), replacement)))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return clean.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
