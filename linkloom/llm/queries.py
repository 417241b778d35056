"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from linkloom.llm import ctw, fingerprints, licenses, linededup, neardup, packing, quality, sentencepiece_bpe, sharding, urls

QUERIES = {
    "op1_ctw_scoring": ctw.op1_ctw_scoring,
    "op2_license_scan": licenses.op2_license_scan,
    "op5_sharding": sharding.op5_sharding,
    "op3_packing": packing.op3_packing,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op6_sentencepiece": sentencepiece_bpe.op6_sentencepiece,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_url_filters": urls.op9_url_filters,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}
ORACLES = {"op8_quality_rules": quality.ORACLE}
