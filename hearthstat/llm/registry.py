"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from hearthstat.llm.op1_quality import op1_quality_rules
from hearthstat.llm.op10_near_duplicates import OP10_SQL, op10_near_duplicates
from hearthstat.llm.op11_embeddings import OP11_SQL, op11_embedding_groups
from hearthstat.llm.op12_conversations import op12_conversation_repair
from hearthstat.llm.op13_vector_codes import OP13_SQL, op13_vector_codes
from hearthstat.llm.op2_templates import op2_site_templates
from hearthstat.llm.op3_bpe import op3_bpe
from hearthstat.llm.op4_mixing import op4_mixing
from hearthstat.llm.op5_ppm import op5_ppm
from hearthstat.llm.op6_edit_counts import op6_edit_counts
from hearthstat.llm.op7_substrings import OP7_SQL, op7_substring_dedup
from hearthstat.llm.op8_suffixes import op8_suffix_dedup
from hearthstat.llm.op9_va_search import OP9_SQL, op9_va_search

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_site_templates": op2_site_templates,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_ppm": op5_ppm,
    "op6_edit_counts": op6_edit_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_va_search": op9_va_search,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_embedding_groups": op11_embedding_groups,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

TWINS: dict[str, str] = {
    "op7_substring_dedup": OP7_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op9_va_search": OP9_SQL,
    "op11_embedding_groups": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
