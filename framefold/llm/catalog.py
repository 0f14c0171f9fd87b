"""Every query of this subpackage, with its oracle where SQL can express it."""
from __future__ import annotations

from framefold.llm import (
    op1_mix, op2_license_scan, op3_fertility, op4_bpe, op5_chat, op6_language, op7_substring_dedup, op8_hpylm, op9_ego_join, op10_minhash,
    op11_repair, op12_prefix_trie, op13_decontaminate,
)

MODULES = (op1_mix, op2_license_scan, op3_fertility, op4_bpe, op5_chat, op6_language, op7_substring_dedup, op8_hpylm, op9_ego_join, op10_minhash,
           op11_repair, op12_prefix_trie, op13_decontaminate)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
