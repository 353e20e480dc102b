"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chosen_path, decontaminate, divergence, filter_audit, merkle, mixing, ngram_jaccard, pii, quality, quotes, secret_scan, suffix_dedup, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_quality": quality.op2_quality,
    "op3_quotes": quotes.op3_quotes,
    "op4_pii": pii.op4_pii,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_merkle": merkle.op7_merkle,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_divergence": divergence.op12_divergence,
    "op13_chosen_path": chosen_path.op13_chosen_path,
}

ORACLE: dict[str, str] = {"op7_merkle": merkle.OP7_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op12_divergence": divergence.OP12_SQL}
