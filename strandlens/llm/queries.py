"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strandlens.llm import license_scan, merkle, mixing, mtree, ordinal, packing, pieces, quality_rules, repeats, secrets, simhash, token_counts, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_classifier": ordinal.op5_quality_classifier,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_top_k": mtree.op8_exact_top_k,
    "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_packing": packing.op12_packing,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op2_quality_rules": quality_rules.SQL, "op8_exact_top_k": mtree.SQL, "op11_merkle_manifest": merkle.SQL}
