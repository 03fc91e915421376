"""Queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from wavegrid.llm.bpe import op9_bpe
from wavegrid.llm.licenses import op7_license_scan
from wavegrid.llm.mixing import op4_source_mixing
from wavegrid.llm.ngram_join import op1_ngram_join
from wavegrid.llm.oracle import ORACLE_SQL
from wavegrid.llm.pii import op10_pii
from wavegrid.llm.quality_model import op5_quality_classifier
from wavegrid.llm.quality_rules import op6_quality_rules
from wavegrid.llm.sketch_dedup import op11_sketch_dedup
from wavegrid.llm.syncmers import op8_syncmer_fingerprints
from wavegrid.llm.token_rollup import op2_token_rollup
from wavegrid.llm.toxicity import op3_toxicity
from wavegrid.llm.turn_trie import op13_turn_trie
from wavegrid.llm.vector_codes import op12_vector_codes

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_rollup": op2_token_rollup,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_syncmer_fingerprints": op8_syncmer_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_sketch_dedup": op11_sketch_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_turn_trie": op13_turn_trie,
}
