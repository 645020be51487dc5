"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from scrubline.llm.byte_bpe import op4_byte_bpe
from scrubline.llm.divergence import op13_source_divergence
from scrubline.llm.html_templates import op10_html_main_text
from scrubline.llm.line_chunks import op9_line_dedup
from scrubline.llm.lm_scoring import op1_lm_scoring
from scrubline.llm.minhash import op11_minhash_dedup
from scrubline.llm.neighbours import op6_nearest
from scrubline.llm.oracles import ORACLES  # noqa: F401
from scrubline.llm.packing import op7_packing
from scrubline.llm.repeats import op5_repeats
from scrubline.llm.simhash import op3_simhash_dedup
from scrubline.llm.spelling import op12_spelling_variants
from scrubline.llm.toxicity import op2_toxicity
from scrubline.llm.winnowing import op8_winnowing

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_repeats": op5_repeats,
    "op6_nearest": op6_nearest,
    "op7_packing": op7_packing,
    "op8_winnowing": op8_winnowing,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_main_text": op10_html_main_text,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}
