"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from duowave.llm import (backtracking, chats, collisions, covertree, dom, licenses, manifest, merges, mixing, ppm, quality, simhash,
                         substrings)

QUERIES = {
    "op1_substring_dedup": substrings.op1,
    "op2_robust_outliers": quality.op2,
    "op3_merge_counts": merges.op3,
    "op4_ppm": ppm.op4,
    "op5_dom_model": dom.op5,
    "op6_license_digests": licenses.op6,
    "op7_backtracking_bpe": backtracking.op7,
    "op8_simhash": simhash.op8,
    "op9_pareto_mix": mixing.op9,
    "op10_collision_counting": collisions.op10,
    "op11_cover_tree_codes": covertree.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_chat_roundtrip": chats.op13,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op6_license_digests": licenses.OP6_SQL,
    "op9_pareto_mix": mixing.OP9_SQL,
    "op11_cover_tree_codes": covertree.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_chat_roundtrip": chats.OP13_SQL,
}
