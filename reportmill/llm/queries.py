"""Queries of the training-data operators, one per operator, and the SQL that checks them."""

from __future__ import annotations

from reportmill.llm import (
    bpe,
    embedding_dedup,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    toxicity,
)
from reportmill.llm.common import prepare


def _shipping(query):
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_secrets": secrets.op5_secrets,
        "op6_simhash": simhash.op6_simhash,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    }
    return {name: _shipping(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op2_quality_rules": quality_rules.ORACLE}
