"""Registry of the subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from leadlake.llm import (
    decontaminate, fingerprint, line_dedup, manifest, mixing, pseudonyms, quality, shingle_join, simhash, token_files,
    toxicity, whitening, wrapper,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_extract": wrapper.op3_extract,
    "op4_shingle_join": shingle_join.op4_shingle_join,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_quality": quality.op6_quality,
    "op7_token_files": token_files.op7_token_files,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_manifest": manifest.op11_manifest,
    "op12_whitening": whitening.op12_whitening,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_manifest": manifest.OP11_SQL,
}
