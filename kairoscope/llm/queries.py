"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, collocations, dart_minhash, decontaminate, exact_dedup, langid, mixing, pii, sharding, suffix_dedup, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chroma_fingerprint": audio.op1,
    "op2_skip_chain_crf": pii.op2,
    "op3_suffix_array": suffix_dedup.op3,
    "op4_dart_minhash": dart_minhash.op4,
    "op5_external_shuffle": sharding.op5,
    "op6_zip_warc": warc.op6,
    "op7_bm25_wand": decontaminate.op7,
    "op8_splitting_tree_mix": mixing.op8,
    "op9_byte_cnn": langid.op9,
    "op10_grammar_round_trip": chat.op10,
    "op11_collocations": collocations.op11,
    "op12_exact_dedup": exact_dedup.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLES: dict[str, str] = {
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
