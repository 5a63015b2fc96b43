"""The queries of this subpackage and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from .exact_dedup import ORACLE as EXACT_DEDUP
from .exact_dedup import op3_exact_dedup
from .language_id import op6_language_id
from .line_dedup import ORACLE as LINE_DEDUP
from .line_dedup import op9_line_dedup
from .media import op2_image_copies
from .ngram_join import ORACLE as NGRAM_JOIN
from .ngram_join import op1_ngram_join
from .packing import op7_best_fit_packing
from .secret_scan import op10_secret_scan
from .sentencepiece import op4_merge_dropout
from .toxicity import op8_toxicity
from .warc import ORACLE as WARC
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_image_copies, op3_exact_dedup, op4_merge_dropout, op5_warc, op6_language_id, op7_best_fit_packing, op8_toxicity, op9_line_dedup, op10_secret_scan)}
ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op3_exact_dedup": EXACT_DEDUP, "op5_warc": WARC, "op9_line_dedup": LINE_DEDUP}
