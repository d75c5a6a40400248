"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from . import bpe, divergence, embedding_dedup, fingerprints, html_extract, langid, line_dedup, minmax_dedup, mixing, periodic_runs, pii, secrets_ledger, speculative_bpe

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_personal_data": pii.op2_personal_data,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_secret_scan": secrets_ledger.op5_secret_scan,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_minhash_dedup": minmax_dedup.op7_minhash_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_speculative_bpe": speculative_bpe.op13_speculative_bpe,
}

#: Where SQL can express the result.
ORACLES = {
    "op5_secret_scan": secrets_ledger.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}
