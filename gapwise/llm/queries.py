"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, langid, mixing, packing, pii, quality, secrets, sharding, simhash, sortmeans, token_counts, topk, wavelet
from .common import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


_OPERATORS = [mixing.op1_mixing, langid.op2_langid, packing.op3_packing, simhash.op4_simhash, pii.op5_pii, quality.op6_quality, sharding.op7_sharding, wavelet.op8_wavelet, secrets.op9_secrets, topk.op10_topk, divergence.op11_divergence, token_counts.op12_tokens, sortmeans.op13_clusters]
QUERIES = {f.__name__: _shipped(f) for f in _OPERATORS}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL, "op6_quality": quality.OP6_SQL, "op10_topk": topk.OP10_SQL, "op11_divergence": divergence.OP11_SQL, "op13_clusters": sortmeans.OP13_SQL}
