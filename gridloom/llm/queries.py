"""The queries of this subpackage, and the SQL that states their rows where SQL can."""

from __future__ import annotations

from . import (
    filter_audit,
    importance,
    jaccard_join,
    license_scan,
    line_dedup,
    mixing,
    nn_descent,
    oracles,
    packing,
    quality_model,
    quality_rules,
    sanitise,
    secret_scan,
    vector_dedup,
)
from .common import documents


def queries() -> dict:
    return {
        "op1_source_mix": lambda spark, d: mixing.op1(documents(spark, d)),
        "op2_secret_scan": lambda spark, d: secret_scan.op2(documents(spark, d)),
        "op3_line_dedup": lambda spark, d: line_dedup.op3(documents(spark, d)),
        "op4_pii_sanitise": lambda spark, d: sanitise.op4(documents(spark, d)),
        "op5_quality_model": lambda spark, d: quality_model.op5(documents(spark, d), documents(spark, d, "labels")),
        "op6_license_scan": lambda spark, d: license_scan.op6(documents(spark, d)),
        "op7_jaccard_join": lambda spark, d: jaccard_join.op7(documents(spark, d)),
        "op9_nn_descent": lambda spark, d: nn_descent.op9(documents(spark, d, "embeddings")),
        "op10_best_fit": lambda spark, d: packing.op10(documents(spark, d)),
        "op8_quality_rules": lambda spark, d: quality_rules.op8(documents(spark, d)),
        "op11_importance": lambda spark, d: importance.op11(documents(spark, d), documents(spark, d, "benchmark")),
        "op12_vector_dedup": lambda spark, d: vector_dedup.op12(documents(spark, d, "embeddings")),
        "op13_filter_audit": lambda spark, d: filter_audit.op13(documents(spark, d), documents(spark, d, "labels")),
        # the columns of four operators that SQL can state
        "base_op1_targets": lambda spark, d: mixing.op1(documents(spark, d)).select("doc_id", "size", "source_size", "target"),
        "base_op2_spans": lambda spark, d: secret_scan.op2(documents(spark, d)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
        "base_op4_spans": lambda spark, d: sanitise.op4(documents(spark, d)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
        "base_op6_places": lambda spark, d: license_scan.op6(documents(spark, d)).select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            "base_labels",
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op7_jaccard_join": oracles.JACCARD,
        "op8_quality_rules": oracles.rules(),
        "op11_importance": importance.SQL,
        "op12_vector_dedup": vector_dedup.SQL,
        "op13_filter_audit": filter_audit.SQL,
        "base_op1_targets": oracles.MIX,
        "base_op2_spans": oracles.SECRETS,
        "base_op4_spans": oracles.PERSONAL,
        "base_op6_places": oracles.LICENCES,
    }
