"""One query per operator over its whole table, with SQL twins where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm import chat, collocations, dropout, exact, fertility, lattice, lines, packing, redirects, simhash, topk, toxicity, whitening


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: op(spark.read.parquet(f"{folder}/{table}.parquet"))


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.op5(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_lattice": _over("documents", lattice.op1),
    "op2_complement_packing": _over("documents", packing.op2),
    "op3_merge_dropout": _over("documents", dropout.op3),
    "op4_redirect_equivalence": _over("pages", redirects.op4),
    "op5_classifier_chain": _toxicity,
    "op6_site_spread": _over("documents", lines.op6),
    "op7_simhash_pigeonring": _over("documents", simhash.op7),
    "op8_budgeted_windows": _over("conversations", chat.op8),
    "op9_polynomial_dedup": _over("documents", exact.exact_groups),
    "op10_histogram_topk": _over("embeddings", topk.op10),
    "op13_bidiagonal_whitening": _over("embeddings", whitening.op13),
    "op11_token_fertility": _over("documents", fertility.op11),
    "op12_dynamic_collocations": _over("documents", collocations.op12),
}
SQL: dict[str, str] = {"op4_redirect_equivalence": redirects.OP4_SQL, "op6_site_spread": lines.OP6_SQL, "op9_polynomial_dedup": exact.OP9_SQL, "op10_histogram_topk": topk.OP10_SQL, "op12_dynamic_collocations": collocations.OP12_SQL}
