"""The contract queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import mixing, neardup, quality
from .ann import op1_ann
from .html import op8_html
from .licenses import op7_licenses
from .lm import op2_lm_score
from .mixing import op5_mixing
from .neardup import op9_neardup
from .packing import op10_packing
from .pii import op3_pii
from .quality import op4_quality
from .sstable import op6_sstable

QUERIES = {
    "op1_ann": op1_ann,
    "op2_lm_score": op2_lm_score,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_sstable": op6_sstable,
    "op7_licenses": op7_licenses,
    "op8_html": op8_html,
    "op9_neardup": op9_neardup,
    "op10_packing": op10_packing,
}
ORACLE_SQL: dict[str, str] = {"op4_quality": quality.ORACLE_SQL, "op5_mixing": mixing.oracle(), "op9_neardup": neardup.ORACLE_SQL}
