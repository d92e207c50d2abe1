"""The operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, fingerprints, hard_negatives, language_model, mixing, near_dedup, quality_model, quality_rules, shared, suffix_dedup, token_files, token_rollup, url_filter, whitening

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.read(spark, sf_dir, "documents")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir), radius=fingerprints.NEAR_RADIUS, neighbours=True)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), near_dedup.CONTRACT)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(shared.read(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.shared_dir(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), out, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.digests(spark, out)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_documents(spark, sf_dir), shared.read(spark, sf_dir, "labels"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under the tokenizer's own counts, which SQL cannot express."""
    return token_rollup.bpe_rollup(_documents(spark, sf_dir), shared.read(spark, sf_dir, "labels"), shared.shared_dir(spark, "rollup"))


def op8_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store under versions that SQL can count: words and a quarter of the bytes."""
    return token_rollup.corpus_rollup(_documents(spark, sf_dir), shared.read(spark, sf_dir, "labels"), shared.shared_dir(spark, "rollup"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), digest=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.with_wrong_labels(shared.read(spark, sf_dir, "embeddings")), hard_negatives.is_anchor())


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(shared.read(spark, sf_dir, "embeddings"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_minhash, op3_mix, op4_url_filter, op5_token_files, op6_quality_rules, op7_quality_fm, op8_token_rollup, op8_word_rollup, op9_suffix_dedup, op10_bpe, op11_hard_negatives, op12_whiten, op13_lm_score)}
ORACLES: dict[str, str] = {"op2_minhash": near_dedup.ORACLE, "op4_url_filter": url_filter.ORACLE, "op8_word_rollup": token_rollup.ORACLE, "op9_suffix_dedup": suffix_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
