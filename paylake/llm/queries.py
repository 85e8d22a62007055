"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from . import embedding_dedup, line_dedup, mixing, simhash
from .byte_bpe import op2_byte_bpe
from .language_id import op3_language_id
from .nearest import op7_nearest
from .token_files import op4_token_files
from .toxicity import op9_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_nearest": op7_nearest,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL}
