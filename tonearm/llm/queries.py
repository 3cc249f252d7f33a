"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tonearm.llm.bpe import op9_byte_bpe
from tonearm.llm.chains import op5_substring_dedup
from tonearm.llm.codes import ORACLE as CODES
from tonearm.llm.codes import op13_vector_codes
from tonearm.llm.jaccard import ORACLE as JACCARD
from tonearm.llm.jaccard import op7_ngram_jaccard_join
from tonearm.llm.language import op4_language_id
from tonearm.llm.packing import op8_best_fit_packing
from tonearm.llm.pii import op10_pii
from tonearm.llm.quality import ORACLE as QUALITY
from tonearm.llm.quality import op1_quality_rules
from tonearm.llm.secrets import op2_secret_scans
from tonearm.llm.simhash import op11_simhash_near_dedup
from tonearm.llm.suffixes import op6_suffix_array_dedup
from tonearm.llm.topk import ORACLE as TOP_K
from tonearm.llm.topk import op3_exact_top_k
from tonearm.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pii": op10_pii,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op1_quality_rules": QUALITY, "op3_exact_top_k": TOP_K, "op7_ngram_jaccard_join": JACCARD, "op13_vector_codes": CODES}
