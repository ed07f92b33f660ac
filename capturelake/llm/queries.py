"""The training-data queries and their SQL. Each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers

from capturelake.llm import bpe, conversations, fingerprints, html_crf, licenses, media, mixing, ngram_join, secrets, suffix_dedup, token_counts, toxicity, whitening
from capturelake.llm.common import read

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def op1_cws_fingerprints(spark, sf_dir):
    return fingerprints.edit_comparison(read(spark, sf_dir, "documents"))


def op2_poisson_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_markov_secrets(spark, sf_dir):
    return secrets.secret_digests(read(spark, sf_dir, "documents"))


def op4_crf_extraction(spark, sf_dir):
    return html_crf.extract(read(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    return media.media_digests(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_toxic_segments(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op11_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op12_feast_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repaired(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_cws_fingerprints, op2_poisson_mixing, op3_markov_secrets, op4_crf_extraction, op5_suffix_dedup, op6_ngram_join, op7_media_columns, op8_byte_bpe, op9_toxic_segments, op10_license_scan, op11_token_counts, op12_feast_whitening, op13_conversation_repair)
}
ORACLE_SQL: dict[str, str] = {"op2_poisson_mixing": mixing.oracle()}
