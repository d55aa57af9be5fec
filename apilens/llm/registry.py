"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from apilens.llm import byte_bpe, exact_dedup, html_extract, mixing, ngram_join, quality_classifier, quality_rules, sharding, url_filter, warc

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_warc": warc.op4_warc,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_sharding": sharding.op8_sharding,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_warc": warc.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
