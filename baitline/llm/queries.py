"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from baitline.llm import oracle
from baitline.llm.exact_topk import op1_exact_topk
from baitline.llm.bpe import op10_bpe
from baitline.llm.embedding_dedup import op13_embedding_dedup
from baitline.llm.html_text import op9_html_text
from baitline.llm.language_id import op5_language_id
from baitline.llm.minhash_dedup import op2_minhash_dedup
from baitline.llm.mixing import op6_mixing
from baitline.llm.nearest import op3_nearest
from baitline.llm.periodic_runs import op11_periodic_runs
from baitline.llm.spelling import op12_spelling_variants
from baitline.llm.substring_dedup import op7_substring_dedup
from baitline.llm.suffix_dedup import op8_suffix_dedup
from baitline.llm.toxicity import op4_toxicity

REGISTRY = {
    "op1_exact_topk": op1_exact_topk,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_text": op9_html_text,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE = oracle.ORACLE
