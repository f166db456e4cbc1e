"""The opN_ queries: thin applications of the operators to the whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, conversation, decontaminate, embedding, langid, linededup, packing, piececoding, quality, secrets, simhash, tokencount, toxicity

QUERIES = {
    "op1_tokencount": tokencount.query,
    "op2_linededup": linededup.query,
    "op3_secrets": secrets.query,
    "op4_simhash": simhash.query,
    "op5_decontaminate": decontaminate.query,
    "op6_quality": quality.query,
    "op7_langid": langid.query,
    "op8_embedding": embedding.query,
    "op9_toxicity": toxicity.query,
    "op10_piececoding": piececoding.query,
    "op11_packing": packing.query,
    "op12_conversation": conversation.query,
    "op13_centroids": centroids.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_linededup": linededup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_embedding": embedding.ORACLE,
    "op12_conversation": conversation.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
