"""Registered queries of the corpus operators, and their SQL oracles."""

from __future__ import annotations

import public_tokenizers

from skein.llm import oracles
from skein.llm.ann import nearest
from skein.llm.bpe import round_trip
from skein.llm.divergence import divergence
from skein.llm.fingerprint import neighbour_likeness
from skein.llm.mixing import mix_documents
from skein.llm.neardup import near_duplicates
from skein.llm.packing import pack_documents
from skein.llm.pii import find_private
from skein.llm.repair import repair
from skein.llm.secrets import BASE as BASE_9
from skein.llm.secrets import RULES as RULES_9
from skein.llm.secrets import find_secrets
from skein.llm.substring import dedup_substrings
from skein.llm.toxicity import score_documents
from skein.llm.urlgraph import RULES, judge_pages
from skein.session import table


def op1_pii(spark, sf_dir):
    return find_private(table(spark, sf_dir, "documents"))


def op2_lz_fingerprint(spark, sf_dir):
    return neighbour_likeness(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op6_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_mix_sources(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"), damaged=True)


QUERIES = {f.__name__: f for f in (op1_pii, op2_lz_fingerprint, op3_best_fit_packing, op4_substring_dedup, op5_toxicity, op6_nearest_neighbours, op7_mix_sources, op8_minhash_neardup, op9_secrets, op10_url_filter, op11_bpe, op12_source_divergence, op13_conversation_repair)}
ORACLES = {
    "op1_pii": oracles.OP1,
    "op4_substring_dedup": oracles.OP4,
    "op6_nearest_neighbours": oracles.OP6,
    "op7_mix_sources": oracles.OP7,
    "op8_minhash_neardup": oracles.OP8,
    "op9_secrets": oracles.op9(RULES_9, BASE_9),
    "op10_url_filter": oracles.op10(RULES),
    "op12_source_divergence": oracles.OP12,
    "op13_conversation_repair": oracles.OP13,
}
