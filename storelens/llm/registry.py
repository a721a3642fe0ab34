"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from storelens.llm.embedding_join import op9_grid_order_join
from storelens.llm.fingerprint import op7_oph_fingerprint
from storelens.llm.langid import op5_language
from storelens.llm.lm_score import op10_bloom_lm
from storelens.llm.mixing import op3_entropy_mix
from storelens.llm.merkle import op12_merkle_butterfly
from storelens.llm.ngram_join import op8_ngram_jaccard
from storelens.llm.oracle import ORACLE_SQL
from storelens.llm.pii import op11_bilstm_pii
from storelens.llm.quality import op1_compression_quality
from storelens.llm.secrets import op6_secret_links
from storelens.llm.spm_codec import op4_sentencepiece
from storelens.llm.toxicity import op2_weak_toxicity
from storelens.llm.whitening import op13_secular_whitening

QUERIES = {
    "op1_compression_quality": op1_compression_quality,
    "op2_weak_toxicity": op2_weak_toxicity,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_secret_links": op6_secret_links,
    "op7_oph_fingerprint": op7_oph_fingerprint,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_grid_order_join": op9_grid_order_join,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_bilstm_pii": op11_bilstm_pii,
    "op12_merkle_butterfly": op12_merkle_butterfly,
    "op13_secular_whitening": op13_secular_whitening,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
