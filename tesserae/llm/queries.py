"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tesserae.llm.ann import op10_nearest
from tesserae.llm.embed_dup import op1_embedding_duplicates
from tesserae.llm.licenses import op2_license_scan
from tesserae.llm.mixing import OP7_SQL, op7_mixing
from tesserae.llm.near_dup import op8_near_duplicates
from tesserae.llm.packing import op3_packing
from tesserae.llm.pii import op9_personal_data
from tesserae.llm.token_counts import op4_token_counts
from tesserae.llm.token_files import op6_token_files
from tesserae.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_embedding_duplicates": op1_embedding_duplicates,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_personal_data": op9_personal_data,
    "op10_nearest": op10_nearest,
}
ORACLES = {
    "op7_mixing": OP7_SQL,
}
