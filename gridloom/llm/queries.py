"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .chat import OP10_SQL, op10_chat_format
from .codes import OP13_SQL, op13_vector_codes
from .cotraining import op5_cotraining
from .interactions import OP11_SQL, op11_filter_interactions
from .langid import op3_language_id
from .licenses import OP6_SQL, op6_license_scan
from .mixing import op4_pfair_mix
from .quality import OP2_ABLATIONS_SQL, OP2_SQL, op2_ablations, op2_quality_rules
from .simhash import op7_simhash
from .topk import OP1_SQL, op1_pivot_topk
from .toxicity import op9_toxicity
from .urlrules import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_quality_rules": op2_quality_rules,
    "op2_ablations": op2_ablations,
    "op3_language_id": op3_language_id,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_cotraining": op5_cotraining,
    "op6_license_scan": op6_license_scan,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_url_filters": op12_url_filters,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_pivot_topk": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op2_ablations": OP2_ABLATIONS_SQL,
    "op6_license_scan": OP6_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_filter_interactions": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
