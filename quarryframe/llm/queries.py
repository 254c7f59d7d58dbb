"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from quarryframe.llm import bpe, chat, langid, minhash, mixing, ngram_join, quality, secrets, topk, toxicity

QUERIES = {
    "op1_minhash": minhash.query,
    "op2_bpe": bpe.query,
    "op3_toxicity": toxicity.query,
    "op4_secrets": secrets.query,
    "op5_chat": chat.query,
    "op6_topk": topk.query,
    "op7_language": langid.query,
    "op8_ngram_join": ngram_join.query,
    "op9_quality": quality.query,
    "op10_mixing": mixing.query,
}

SQL: dict[str, str] = {
    "op5_chat": chat.SQL,
    "op6_topk": topk.SQL,
}
