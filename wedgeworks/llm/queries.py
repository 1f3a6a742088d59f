"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, html_extraction, mixing, near_dedup, pii, quality_crf, quality_rules, token_counts, url_filters, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_warc": warc.op2_warc,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_pii": pii.op5_pii,
    "pii_base": pii.pii_base,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_crf": quality_crf.op10_quality_crf,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_warc": warc.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op4_url_filters": url_filters.SQL,
    "pii_base": pii.BASE_SQL,
    "op8_decontamination": decontamination.SQL,
    "op9_mixing": mixing.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
