"""The queries of this subpackage and their SQL for __spark_entry__.py."""

from __future__ import annotations

from . import exact_dedup, kneser_ney, licences, mixing, near_dedup, packing, personal, secrets, topk, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_source_mixing": mixing.op2,
    "op8_exact_topk": topk.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_near_dedup": near_dedup.op10,
    "op3_secret_scan": secrets.op3,
    "op4_lm_scoring": kneser_ney.op4,
    "op5_licence_scan": licences.op5,
    "op6_toxicity": toxicity.op6,
    "op7_personal_data": personal.op7,
}
SQL = {
    "op5_licence_scan": licences.OP5_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
}
