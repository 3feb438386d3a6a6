"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pingmill.llm import bpe, capfilter, chunks, huffman, language, media, merkle, mixing, negatives, secrets, simhash, substring, warc
from pingmill.llm.common import Query


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_transducer": bpe.op1,
        "op2_gear_passages": substring.op2,
        "op3_huffman_ids": huffman.op3,
        "op4_simhash_gray": simhash.op4,
        "op5_curriculum_mix": mixing.op5,
        "op6_secret_forest": secrets.op6,
        "op7_cap_filters": capfilter.op7,
        "op8_language_bitmask": language.op8,
        "op9_media_archives": media.op9,
        "op10_warc_chunks": warc.op10,
        "op11_merkle_octopus": merkle.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_chunk_reuse_bpe": chunks.op13,
        "pipeline": _pipeline,
        "media_payload_digests": media.payload_digests,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_curriculum_mix": mixing.ORACLE, "op7_cap_filters": capfilter.ORACLE, "op10_warc_chunks": warc.ORACLE, "op11_merkle_octopus": merkle.ORACLE, "op12_hard_negatives": negatives.ORACLE, "media_payload_digests": media.ORACLE}
