"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from lectern.llm import (
    align, centroids, chat, decontam, kneser_ney, licenses, mixing, near, pii, quality, secrets, tokens, warc,
)

QUERIES = {
    "op11_token_alignment": align.op11,
    "op12_chat_assembly": chat.op12,
    "op13_ptolemaic_clusters": centroids.op13,
    "op10_kneser_ney": kneser_ney.op10,
    "op8_license_index": licenses.op8,
    "op9_length_histogram": tokens.op9,
    "op1_edit_matching": decontam.op1,
    "op2_warc_segments": warc.op2,
    "op3_pii_disclosure": pii.op3,
    "op4_systematic_mix": mixing.op4,
    "op5_secret_entropy": secrets.op5,
    "op6_superminhash": near.op6,
    "op7_quality_divergence": quality.op7,
}
ORACLES: dict[str, str] = {
    "op6_superminhash": near.sql(),
    "op12_chat_assembly": chat.SQL,
    "op13_ptolemaic_clusters": centroids.SQL,
    "op2_warc_segments": warc.SQL,
    "op4_systematic_mix": mixing.SQL,
}
