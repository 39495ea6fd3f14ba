"""Named queries of the training-data operators."""

from __future__ import annotations

from colsense.llm import byte_bpe, exact_topk, html_extract, jump_shards, license_scan, line_crf, quality_rules, simhash, source_mix, token_files

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_line_crf": line_crf.query,
    "op3_token_files": token_files.query,
    "op4_quality_rules": quality_rules.query,
    "op5_source_mix": source_mix.query,
    "op6_license_scan": license_scan.query,
    "op7_simhash": simhash.query,
    "op8_jump_shards": jump_shards.query,
    "op9_html_extract": html_extract.query,
    "op10_exact_topk": exact_topk.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op10_exact_topk": exact_topk.ORACLE,
}
