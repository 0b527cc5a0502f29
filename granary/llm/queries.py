"""The queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from granary.llm import bpe, exact, gif, language, lm_score, merkle, minhash, mixing, simhash, spelling, substring, tokens, toxicity

QUERIES = {
    "op1_simhash_pivots": simhash.op1_simhash_pivots,
    "op2_exact_refine": exact.op2_exact_refine,
    "op3_language_ppm": language.op3_language_ppm,
    "op4_toxicity_nnpu": toxicity.op4_toxicity_nnpu,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_substring_rlz": substring.op6_substring_rlz,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_cross_entropy_difference": lm_score.op8_cross_entropy_difference,
    "op9_temperature_mix": mixing.op9_temperature_mix,
    "op10_gif_media": gif.op10_gif_media,
    "op11_minhash_inverted": minhash.op11_minhash_inverted,
    "op12_spelling_fst": spelling.op12_spelling_fst,
    "op13_merkle_veb": merkle.op13_merkle_veb,
    "gif_frames": gif.gif_frame_digests,
}

ORACLES: dict[str, str] = {
    "op2_exact_refine": exact.OP2_SQL,
    "op6_substring_rlz": substring.OP6_SQL,
    "op11_minhash_inverted": minhash.OP11_SQL,
    "op12_spelling_fst": spelling.OP12_SQL,
    "op13_merkle_veb": merkle.OP13_SQL,
}
