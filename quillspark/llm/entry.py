"""The corpus queries and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import chat, decontaminate, embeddings, fim, html, langid, licenses, lm, minhash, pieces, suffix, toxicity, variants


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_langid": langid.op2_langid,
        "op3_minhash": minhash.op3_minhash,
        "op4_suffix_array": suffix.op4_suffix_array,
        "op5_embeddings": embeddings.op5_embeddings,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_lm_score": lm.op8_lm_score,
        "op9_chat": chat.op9_chat,
        "op10_html": html.op10_html,
        "op11_license_scan": licenses.op11_license_scan,
        "op12_spelling": variants.op12_spelling,
        "op13_fill_in_middle": fim.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash": minhash.OP3_SQL,
        "op5_embeddings": embeddings.OP5_SQL,
        "op9_chat": chat.OP9_SQL,
        "op11_license_scan": licenses.OP11_SQL,
        "op12_spelling": variants.OP12_SQL,
        "op13_fill_in_middle": fim.OP13_SQL,
    }
