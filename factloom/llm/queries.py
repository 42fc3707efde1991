"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from factloom.llm import oracles
from factloom.llm.decontaminate import op4_decontamination
from factloom.llm.embedding_dedup import op7_embedding_dedup
from factloom.llm.html_text import op10_html_text
from factloom.llm.jaccard_join import op3_jaccard_join
from factloom.llm.language_id import op8_language_id
from factloom.llm.license_scan import op9_license_scan
from factloom.llm.packing import op1_best_fit_packing
from factloom.llm.pii import op5_pii
from factloom.llm.quality import op2_quality_classifier
from factloom.llm.token_counts import op6_token_counts

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_jaccard_join, op4_decontamination, op5_pii, op6_token_counts, op7_embedding_dedup, op8_language_id, op9_license_scan, op10_html_text)}
ORACLES = {"op3_jaccard_join": oracles.JACCARD, "op7_embedding_dedup": oracles.EMBEDDINGS, "op9_license_scan": oracles.LICENSES}
