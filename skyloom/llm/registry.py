"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import OP1_SQL, op1_decontaminate
from .jaccard import OP5_SQL, op5_jaccard
from .language_id import op10_language_id
from .licenses import op6_licenses
from .mixing import OP2_SQL, op2_mixing
from .quality import op7_quality
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .topk_search import OP4_SQL, op4_topk_search
from .toxicity import op9_toxicity
from .url_reputation import OP8_SQL, op8_url_reputation

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontaminate": op1_decontaminate,
    "op2_mixing": op2_mixing,
    "op7_quality": op7_quality,
    "op5_jaccard": op5_jaccard,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op8_url_reputation": op8_url_reputation,
    "op6_licenses": op6_licenses,
    "op9_toxicity": op9_toxicity,
    "op4_topk_search": op4_topk_search,
    "op10_language_id": op10_language_id,
}

ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op5_jaccard": OP5_SQL,
    "op8_url_reputation": OP8_SQL,
    "op4_topk_search": OP4_SQL,
}
