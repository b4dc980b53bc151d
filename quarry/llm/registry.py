"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from quarry.llm.fingerprint import op1_fingerprint
from quarry.llm.language import op3_language
from quarry.llm.language_model import op6_language_model
from quarry.llm.mixing import OP10_SQL, op10_mixing
from quarry.llm.near_dedup import op7_near_dedup
from quarry.llm.packing import op5_packing
from quarry.llm.sharding import op9_sharding
from quarry.llm.token_files import op4_token_files
from quarry.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_language_model": op6_language_model,
    "op7_near_dedup": op7_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
}

SQL = {"op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL}
