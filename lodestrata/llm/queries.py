"""The numbered queries, one per operator, and the SQL that gives the same rows where SQL can."""

from .bpe import op10_bpe
from .fingerprints import op9_fingerprints
from .kneser_ney import op7_quality_classifier
from .language_id import op5_language_id
from .near_dedup import op3_near_dedup
from .packing import op6_packing
from .quality_rules import op8_quality_rules
from .spelling import op13_spelling
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op1_token_counts
from .token_files import op12_token_files
from .toxicity import op2_toxicity
from .whitening import op11_whitening

NUMBERED = (
    op1_token_counts, op2_toxicity, op3_near_dedup, op4_suffix_dedup, op5_language_id, op6_packing, op7_quality_classifier,
    op8_quality_rules, op9_fingerprints, op10_bpe, op11_whitening, op12_token_files, op13_spelling,
)
QUERIES = {f.__name__: f for f in NUMBERED}
#: None of these can be said in SQL (vocabularies, sketches, trained models, or too slow as a plain join); tests hold them against brute force.
ORACLES: dict[str, str] = {}
