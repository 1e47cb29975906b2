"""The queries opN_<name>, and DuckDB SQL where it can express one."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .exact_topk import OP3_SQL, op3_exact_topk
from .jaccard_join import OP1_SQL, op1_ngram_jaccard_join
from .katz import op9_katz_scores
from .license_scan import op10_license_scan
from .mixing import OP8_SQL, op8_mixing
from .quality import op4_quality
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_exact_topk": op3_exact_topk,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_katz_scores": op9_katz_scores,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_exact_topk": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_mixing": OP8_SQL,
}
