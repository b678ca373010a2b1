"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from idlecost.llm import (
    chat_format,
    exact_dedup,
    filter_audit,
    jaccard_join,
    language_id,
    line_templates,
    mixing,
    packing,
    period_runs,
    pii,
    quality_rules,
    secret_scan,
    toxicity,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_templates": line_templates.op2_line_templates,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_period_runs": period_runs.op13_period_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
