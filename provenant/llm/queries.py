"""The corpus operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe
from .exact import OP5_SQL, op5_exact_dedup
from .html import op3_html
from .katz import op6_katz
from .langid import op1_langid
from .media import op4_media
from .packing import op10_packing
from .quality import op7_quality
from .simhash import op8_simhash
from .suffixes import op2_suffix_dedup

QUERIES = {
    "op1_langid": op1_langid,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html": op3_html,
    "op4_media": op4_media,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_katz": op6_katz,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
}
