"""The queries of this subpackage, and their SQL where SQL can express them."""
from __future__ import annotations

from .fingerprints import op4
from .html_text import op10
from .language import op6
from .mixing import ORACLE8, op8
from .packing import op9
from .phrases import ORACLE13, op13
from .quality import ORACLE5, op5
from .sharding import op1
from .simhash import op3
from .spelling import ORACLE12, op12
from .substrings import op2
from .toxicity import op11
from .warc import op7

QUERIES = {
    "op1_sharding": op1,
    "op2_substrings": op2,
    "op3_simhash": op3,
    "op4_fingerprints": op4,
    "op5_quality": op5,
    "op6_language": op6,
    "op7_warc": op7,
    "op8_mixing": op8,
    "op9_packing": op9,
    "op10_html_text": op10,
    "op11_toxicity": op11,
    "op12_spelling": op12,
    "op13_phrases": op13,
}
ORACLE = {
    "op5_quality": ORACLE5,
    "op8_mixing": ORACLE8,
    "op12_spelling": ORACLE12,
    "op13_phrases": ORACLE13,
}
