"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from . import decontamination, license_scan, mixing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

#: Fingerprints, trained models, similarities and byte windows are beyond SQL, or too slow in it; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_mixing": mixing.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
}
