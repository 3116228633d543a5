"""Queries of this package by name, and the SQL of those that SQL can express."""

from textveil.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from textveil.llm.fingerprints import op3_fingerprints
from textveil.llm.jaccard_join import OP8_SQL, op8_jaccard
from textveil.llm.language import op4_language
from textveil.llm.line_dedup import OP6_SQL, op6_line_dedup
from textveil.llm.mixing import op1_mixing
from textveil.llm.packing import op9_packing
from textveil.llm.quality import op7_quality
from textveil.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from textveil.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {"op2_embedding_dedup": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_jaccard": OP8_SQL}
