"""Queries of the text operators, and their SQL where SQL can express them."""

from .byte_bpe import op10_byte_bpe
from .crf_language import op1_crf_language
from .cross_polytope import op6_cross_polytope
from .fuzzy_lines import op9_fuzzy_lines
from .gam_quality import op4_gam_quality
from .icws_minhash import op5_icws_minhash
from .spaced_seeds import op8_spaced_seeds
from .suffix_groups import op3_suffix_groups
from .template_html import op2_template_html
from .trigram_secrets import op7_trigram_secrets

QUERIES = {
    "op1_crf_language": op1_crf_language,
    "op4_gam_quality": op4_gam_quality,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op5_icws_minhash": op5_icws_minhash,
    "op6_cross_polytope": op6_cross_polytope,
    "op2_template_html": op2_template_html,
    "op3_suffix_groups": op3_suffix_groups,
    "op10_byte_bpe": op10_byte_bpe,
    "op7_trigram_secrets": op7_trigram_secrets,
}
ORACLE_SQL: dict[str, str] = {}
