"""The corpus operators' queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import alignment, exact_dedup, hmm, imatch, lines, mixing, packing, quality, rans, search, secrets, simhash, substrings

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_rans_token_files": rans.op8_rans_token_files,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_hmm_scores": hmm.op10_hmm_scores,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_imatch_fingerprints": imatch.op12_imatch_fingerprints,
    "op13_cross_alignment": alignment.op13_cross_alignment,
}

#: The others are not expressible in SQL; tests hold them against plain Python, op2's and op7's drawn parts by what they must keep.
SQL = {
    "op3_quality_rules": quality.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_ranked_search": search.OP11_SQL,
}
