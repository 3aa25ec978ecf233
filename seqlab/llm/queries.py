"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .jpeg import op5_media_jpeg
from .lexical import OP13_SQL, op13_lexical_search
from .licenses import OP7_SQL, op7_license_scan
from .near_dup import op6_minhash_near_dedup
from .packing import op9_best_fit_packing
from .periodic import op12_periodic_runs
from .quality import op4_quality_co_training
from .simhash import op11_simhash_near_dedup
from .substring import OP8_SQL, op8_substring_dedup
from .topk import OP1_SQL, op1_exact_top_k
from .toxicity import op3_toxicity
from .warc import OP10_SQL, op10_warc_zip

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_quality_co_training": op4_quality_co_training,
    "op5_media_jpeg": op5_media_jpeg,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc_zip": op10_warc_zip,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op7_license_scan": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc_zip": OP10_SQL, "op13_lexical_search": OP13_SQL}
