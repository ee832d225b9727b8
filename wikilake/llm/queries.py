"""Queries of this subpackage and the SQL of two; tests compare the others with brute force, round trips or held-out labels."""

from __future__ import annotations

from wikilake.llm import clusters, prefixes
from wikilake.llm.bpe import op7_bpe
from wikilake.llm.clusters import op13_clusters
from wikilake.llm.decontaminate import op2_decontaminate
from wikilake.llm.fingerprint import op10_fingerprint
from wikilake.llm.htmltext import op6_html_text
from wikilake.llm.jaccard import op8_jaccard_join
from wikilake.llm.langid import op9_language
from wikilake.llm.lmscore import op3_lm_score
from wikilake.llm.mixing import op11_mixing
from wikilake.llm.pii import op4_pii
from wikilake.llm.prefixes import op12_prefix_trie
from wikilake.llm.secrets import op5_secrets
from wikilake.llm.toxicity import op1_toxicity

QUERIES = {"op1_toxicity": op1_toxicity, "op2_decontaminate": op2_decontaminate, "op3_lm_score": op3_lm_score, "op4_pii": op4_pii, "op5_secrets": op5_secrets, "op6_html_text": op6_html_text, "op7_bpe": op7_bpe, "op8_jaccard_join": op8_jaccard_join, "op9_language": op9_language, "op10_fingerprint": op10_fingerprint, "op11_mixing": op11_mixing, "op12_prefix_trie": op12_prefix_trie, "op13_clusters": op13_clusters}
SQL: dict[str, str] = {"op12_prefix_trie": prefixes.SQL, "op13_clusters": clusters.SQL}
