"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from kgspark.llm import (
    decontaminate, host_rules, near_dup, pieces, sim_hash, site_style, snapshots, spelling, suffix_automaton,
    suffix_tree, token_store, toxicity, whitening,
)
from kgspark.llm.twins import ORACLE_SQL
from kgspark.plans.registry import Tables

BYTE_BPE = "byte_bpe_50k.json"


def op1_benchmark_decontamination(t: Tables):
    return decontaminate.digest(decontaminate.find_contamination(t.documents, t.benchmark, t.scratch))


def op2_suffix_array_dedup(t: Tables):
    return suffix_tree.digest(suffix_tree.dedup_bytes(t.documents, t.scratch))


def op3_host_quality_rules(t: Tables):
    return host_rules.judge(t.documents, t.scratch).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_sentencepiece(t: Tables):
    return pieces.encode_digests(t.documents, public_tokenizers.path(pieces.VOCABULARY))


def op5_minhash_near_dedup(t: Tables):
    return near_dup.near_duplicates(t.documents, t.scratch)


def op6_html_extraction(t: Tables):
    return site_style.extract(t.pages, t.scratch)


def op7_toxicity(t: Tables):
    return toxicity.judge(t.documents, t.labels)


def op8_token_ids(t: Tables):
    return token_store.store(t.documents, public_tokenizers.path(BYTE_BPE), t.scratch)


def op9_chat_snapshots(t: Tables):
    return snapshots.collapse_and_render(t.conversations, t.scratch)


def op10_substring_dedup(t: Tables):
    return suffix_automaton.digest(suffix_automaton.dedup_words(t.documents, t.scratch))


def op11_simhash_near_dedup(t: Tables):
    return sim_hash.digest(sim_hash.near_duplicates(t.documents, t.scratch))


def op12_spelling_variants(t: Tables):
    return spelling.group_variants(t.documents, t.scratch)


def op13_embedding_whitening(t: Tables):
    return whitening.whiten(t.embeddings)


_ALL = [
    op1_benchmark_decontamination, op2_suffix_array_dedup, op3_host_quality_rules, op4_sentencepiece,
    op5_minhash_near_dedup, op6_html_extraction, op7_toxicity, op8_token_ids, op9_chat_snapshots,
    op10_substring_dedup, op11_simhash_near_dedup, op12_spelling_variants, op13_embedding_whitening,
]


def queries():
    return {f.__name__: (lambda spark, folder, f=f: f(Tables(spark, folder))) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
