"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_alignment
from .bpe import op5_bpe
from .language_model import op10_language_model
from .lines import OP11_SQL, op11_line_dedup
from .media import op8_media
from .neighbours import op1_nearest
from .near_duplicates import op4_near_duplicates
from .packing import op2_packing
from .pii import op6_pii
from .quality import op7_quality
from .repeats import op3_repeats
from .resampling import OP12_SQL, op12_resampling
from .url_filter import op9_url_filter

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_url_filter": op9_url_filter,
    "op10_language_model": op10_language_model,
    "op11_line_dedup": op11_line_dedup,
    "op12_resampling": op12_resampling,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op11_line_dedup": OP11_SQL, "op12_resampling": OP12_SQL}
