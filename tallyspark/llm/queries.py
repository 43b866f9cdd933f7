"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import caps, forest, lexical, licenses, line_dedup, minhash, mixing, packing, quality, resample, secrets, suffixes, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": licenses.op1_licenses,
    "op2_pack": packing.op2_pack,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_caps": caps.op4_caps,
    "op5_mix": mixing.op5_mix,
    "op6_lines": line_dedup.op6_lines,
    "op7_minhash": minhash.op7_minhash,
    "op8_quality": quality.op8_quality,
    "op9_secrets": secrets.op9_secrets,
    "op10_topk": topk.op10_topk,
    "op11_lexical": lexical.op11_lexical,
    "op12_forest": forest.op12_forest,
    "op13_resample": resample.op13_resample,
}
ORACLES: dict[str, str] = {
    "op4_caps": caps.SQL,
    "op5_mix": mixing.SQL,
    "op6_lines": line_dedup.SQL,
    "op7_minhash": minhash.SQL,
    "op10_topk": topk.SQL,
    "op11_lexical": lexical.SQL,
    "op13_resample": resample.SQL,
}
