"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tidings.llm import alignment, decontaminate, hard_negatives, language, lines, mixing, passages, quality_model, quality_rules, simhash, suffix_dedup, token_files, toxicity
from tidings.llm.common import table


def op4_token_files(spark, sf_dir):
    return token_files.token_rows(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


def op6_lines(spark, sf_dir):
    return lines.digest(table(spark, sf_dir, "pages"))


def op7_passages(spark, sf_dir):
    return passages.stripped(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark, sf_dir):
    return language.predicted(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op9_quality_model(spark, sf_dir):
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_suffixes(spark, sf_dir):
    return suffix_dedup.stripped(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op6_lines": lines.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op12_suffixes": suffix_dedup.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
