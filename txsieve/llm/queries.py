"""The operators of this folder as queries over the test tables, and as DuckDB SQL where it can express them."""

from __future__ import annotations

from txsieve.llm.alignment import op13_alignment
from txsieve.llm.bpe import op5_bpe
from txsieve.llm.fingerprints import op9_fingerprints
from txsieve.llm.html_extraction import op12_html_extraction
from txsieve.llm.jaccard_join import op6_jaccard_join
from txsieve.llm.lm_scoring import op1_lm_scoring
from txsieve.llm.mixing import OP4_SQL, op4_mixing
from txsieve.llm.quality_classifier import op7_quality
from txsieve.llm.quality_rules import op8_quality_rules
from txsieve.llm.toxicity import op2_toxicity
from txsieve.llm.vector_clusters import OP11_SQL, op11_clusters
from txsieve.llm.warc import OP3_SQL, op3_warc
from txsieve.llm.wavelet import op10_wavelet

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_fingerprints": op9_fingerprints,
    "op10_wavelet": op10_wavelet,
    "op11_clusters": op11_clusters,
    "op12_html_extraction": op12_html_extraction,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op3_warc": OP3_SQL, "op4_mixing": OP4_SQL, "op11_clusters": OP11_SQL}
