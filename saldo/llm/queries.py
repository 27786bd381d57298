"""The registered queries of the operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from saldo.llm import alignment, bpe_words, conversations, decontaminate, fingerprint, html_text, mixture, neardup, oracles, pii, repeats, site_quality, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), mixture.quality_weights(table(spark, sf_dir, "labels")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns), turns.select("conv_id").distinct())


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_toxicity, op3_fingerprint, op4_neardup, op5_bpe, op6_html, op7_decontaminate, op8_token_counts, op9_site_quality, op10_repeats, op11_mixture, op12_conversations, op13_alignment)
}
ORACLES: dict[str, str] = {"op4_neardup": oracles.NEARDUP, "op7_decontaminate": oracles.DECONTAMINATE, "op10_repeats": oracles.REPEATS, "op11_mixture": oracles.MIXTURE, "op12_conversations": oracles.CONVERSATIONS}
