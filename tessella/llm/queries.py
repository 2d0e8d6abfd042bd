"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import byte_bpe, byte_cnn, exact_dedup, filter_audit, jaccard_join, line_dedup, matroska, minhash_dedup, mixing, pitman_yor, suffix_dedup, warc, whitening
from tessella.llm.shared import importable

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_query,
    "op2_exact_dedup": exact_dedup.op2_query,
    "op3_pitman_yor": pitman_yor.op3_query,
    "op4_mixing": mixing.op4_query,
    "op5_line_dedup": line_dedup.op5_query,
    "op6_warc_round_trip": warc.op6_query,
    "op7_jaccard_join": jaccard_join.op7_query,
    "op8_byte_cnn_quality": byte_cnn.op8_query,
    "op9_matroska": matroska.op9_query,
    "op10_byte_bpe": byte_bpe.op10_query,
    "op11_minhash_dedup": minhash_dedup.op11_query,
    "op12_filter_audit": filter_audit.op12_query,
    "op13_whitening": whitening.op13_query,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_warc_round_trip": warc.OP6_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op11_minhash_dedup": minhash_dedup.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}


def _ready(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _ready(query) for name, query in _QUERIES.items()}
