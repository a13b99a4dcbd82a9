"""The queries of the training-data operators and their DuckDB SQL."""

from kiln.llm import (
    bitplane_tokens,
    chat_parts,
    decontaminate,
    fast_minhash,
    gram_index,
    hilbert_shards,
    itq_dedup,
    lang_viterbi,
    merkle_manifest,
    mix_threshold,
    pii_score,
    rule_ledger,
    toxicity,
)

QUERIES = {
    "op1_kneser_ney_toxicity": toxicity.op1_kneser_ney_toxicity,
    "op2_hilbert_shards": hilbert_shards.op2_hilbert_shards,
    "op3_chat_parts": chat_parts.op3_chat_parts,
    "op4_latent_decontamination": decontaminate.op4_latent_decontamination,
    "op5_fast_minhash": fast_minhash.op5_fast_minhash,
    "op6_bitplane_tokens": bitplane_tokens.op6_bitplane_tokens,
    "op7_lang_viterbi": lang_viterbi.op7_lang_viterbi,
    "op8_pii_score": pii_score.op8_pii_score,
    "op9_mix_threshold": mix_threshold.op9_mix_threshold,
    "op10_rule_ledger": rule_ledger.op10_rule_ledger,
    "op11_gram_variants": gram_index.op11_gram_variants,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_itq_vectors": itq_dedup.op13_itq_vectors,
}

ORACLE = {
    "op5_fast_minhash": fast_minhash.ORACLE,
    "op3_chat_parts": chat_parts.ORACLE,
    "op9_mix_threshold": mix_threshold.ORACLE,
    "op10_rule_ledger": rule_ledger.ORACLE,
    "op11_gram_variants": gram_index.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
    "op13_itq_vectors": itq_dedup.ORACLE,
}
