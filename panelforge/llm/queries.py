"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, licenses, line_rules, mixing, packing, pii, quality_rff, topk, toxicity, url_lm
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def _labelled(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": _over("pages", url_lm.filter_urls),
    "op2_quality": _labelled(quality_rff.quality_scores),
    "op3_exact_topk": _over("embeddings", topk.topk_query),
    "op4_pii_surrogates": _over("documents", pii.pii_query),
    "op5_line_rules": _over("documents", line_rules.quality_query),
    "op6_license_scan": _over("documents", licenses.scan_licenses),
    "op7_packing": _over("documents", packing.pack),
    "op8_jaccard_join": _over("documents", jaccard_join.near_duplicates),
    "op9_toxicity": _labelled(toxicity.toxicity_scores),
    "op10_mixing": _over("documents", mixing.mixing_query),
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": topk.ORACLE,
    "op5_line_rules": line_rules.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
}
