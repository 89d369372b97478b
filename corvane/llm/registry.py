"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chat, decontaminate, jaccard_join, language_id, mpeg_audio, packing, phrases, resharding, secret_scan, token_counts, toxicity, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.query,
        "op2_token_counts": token_counts.query,
        "op3_chat_format": chat.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_toxicity": toxicity.query,
        "op6_packing": packing.query,
        "op7_mpeg_audio": mpeg_audio.query,
        "op8_decontamination": decontaminate.query,
        "op9_secret_scan": secret_scan.query,
        "op10_warc": warc.query,
        "op11_phrases": phrases.query,
        "op12_resharding": resharding.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": jaccard_join.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op10_warc": warc.ORACLE, "op11_phrases": phrases.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
