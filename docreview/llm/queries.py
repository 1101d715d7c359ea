"""The registered queries of the subpackage and their SQL; SQL is missing where it cannot say the operator."""

from __future__ import annotations

from docreview.llm import (alignment, bpe, chat, exact_dedup, fingerprint, langid, line_dedup, minhash, mixing, pii, quality,
                           repair, warc)

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_warc": warc.op5_warc,
    "op6_minhash": minhash.op6_minhash,
    "op7_langid": langid.op7_langid,
    "op8_quality": quality.op8_quality,
    "op9_format_preferences": chat.op9_format_preferences,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_pii": pii.op11_pii,
    "op12_repair": repair.op12_repair,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op5_warc": warc.SQL, "op3_line_dedup": line_dedup.SQL, "op9_format_preferences": chat.SQL, "op10_exact_dedup": exact_dedup.SQL}
