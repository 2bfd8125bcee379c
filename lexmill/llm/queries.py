"""The thin opN_<name> queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from lexmill.llm import codes, fingerprints, flac, langid, linedup, mixing, ngram_join, pii, sharding, spm, substring, warc, whitening
from lexmill.session import table


def _on(name: str, op):
    return lambda spark, sf_dir: op(spark, table(spark, sf_dir, name))


def queries() -> dict:
    return {
        "op1_warc_archive": _on("pages", warc.op1),
        "op2_source_mixing": _on("documents", mixing.op2),
        "op3_ngram_join": _on("documents", ngram_join.op3),
        "op4_pii": _on("documents", pii.op4),
        "op5_substring_dedup": _on("documents", substring.op5),
        "op6_flac_media": _on("documents", flac.op6),
        "op7_line_dedup": _on("documents", linedup.op7),
        "op8_sentencepiece": _on("documents", spm.op8),
        "op9_language_id": _on("documents", langid.op9),
        "op10_fingerprints": _on("documents", fingerprints.op10),
        "op11_embedding_whitening": _on("embeddings", whitening.op11),
        "op12_vector_codes": _on("embeddings", codes.op12),
        "op13_sharding": _on("documents", sharding.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": warc.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op5_substring_dedup": substring.ORACLE, "op7_line_dedup": linedup.ORACLE, "op12_vector_codes": codes.ORACLE, "op13_sharding": sharding.ORACLE}
