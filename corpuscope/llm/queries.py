"""The queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_winnowing_decontamination
from .langid import op11_language_identification
from .language import op5_pitman_yor_scores
from .licenses import op10_license_templates
from .manifest import OP12_SQL, op12_merkle_manifest
from .nearest import op1_inverted_file_search
from .neardup import OP2_SQL, op2_minhash_near_dedup
from .packing import op3_best_fit_packing
from .phrases import OP13_SQL, op13_phrase_collocations
from .quality import op9_positive_unlabelled_quality
from .repeats import op7_suffix_array_dedup
from .tokens import op4_token_id_output
from .toxicity import op6_recurrent_toxicity

QUERIES = {f.__name__: f for f in (op1_inverted_file_search, op2_minhash_near_dedup, op3_best_fit_packing, op4_token_id_output, op5_pitman_yor_scores, op6_recurrent_toxicity, op7_suffix_array_dedup, op8_winnowing_decontamination, op9_positive_unlabelled_quality, op10_license_templates, op11_language_identification, op12_merkle_manifest, op13_phrase_collocations)}
SQL: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op8_winnowing_decontamination": OP8_SQL, "op12_merkle_manifest": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
