"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_trees, decontaminate, link_graph, lm_score, merkle_manifest, mpeg_audio, near_dup, packing, quality_llr, secret_novelty, shuffle_matrix, token_alignment, toxic_crf

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_chat_trees": chat_trees.op2_chat_trees,
    "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_shuffle_matrix": shuffle_matrix.op6_shuffle_matrix,
    "op7_secret_novelty": secret_novelty.op7_secret_novelty,
    "op8_link_graph": link_graph.op8_link_graph,
    "op9_packing": packing.op9_packing,
    "op10_toxic_crf": toxic_crf.op10_toxic_crf,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_quality_llr": quality_llr.op12_quality_llr,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op2_chat_trees": chat_trees.ORACLE,
    "op12_quality_llr": quality_llr.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
