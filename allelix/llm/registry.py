"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from allelix.llm.ann import op3_nearest_neighbours
from allelix.llm.bpe import op10_bpe
from allelix.llm.chat_format import op8_chat_formatting
from allelix.llm.fingerprint import op13_document_fingerprints
from allelix.llm.html_extract import op4_html_extraction
from allelix.llm.merkle import OP12_SQL, op12_merkle_manifest
from allelix.llm.ngram_join import op2_ngram_jaccard_join
from allelix.llm.packing import op7_best_fit_packing
from allelix.llm.quality import op6_quality_classifier
from allelix.llm.quality_rules import OP9_SQL, op9_quality_rules
from allelix.llm.ranked_search import OP11_SQL, op11_ranked_search
from allelix.llm.toxicity import op1_toxicity
from allelix.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_ngram_jaccard_join,
        op3_nearest_neighbours,
        op4_html_extraction,
        op5_url_filter,
        op6_quality_classifier,
        op7_best_fit_packing,
        op8_chat_formatting,
        op9_quality_rules,
        op10_bpe,
        op11_ranked_search,
        op12_merkle_manifest,
        op13_document_fingerprints,
    )
}
ORACLES = {"op5_url_filter": OP5_SQL, "op9_quality_rules": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
