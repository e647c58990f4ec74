"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from brindle.llm import decontaminate, line_dedup, packing, quality, secrets, sharding, simhash, substring_dedup, toxicity, urls

QUERIES = {
    "op1_secret_scans": secrets.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_sharding": sharding.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_rules": quality.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_line_dedup": line_dedup.query,
    "op8_url_filters": urls.query,
    "op9_packing": packing.query,
    "op10_toxicity": toxicity.query,
}
ORACLES: dict[str, str] = {
    "op1_secret_scans": secrets.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
