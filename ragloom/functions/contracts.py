"""Contracts as slices (doc_id, clause_no, category, text): findings, suggestions, comparison with templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE = "unlimited liability"


def _risky():
    return F.contains(F.lower("text"), F.lit(PHRASE))


def not_empty(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices with text, and those to set aside."""
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    return slices.where(~blank), slices.where(blank)


def risks(slices: DataFrame) -> DataFrame:
    return slices.where(_risky()).select("doc_id", "clause_no", F.lit("high").alias("severity"), F.lit("liability").alias("category"))


def revisions(slices: DataFrame) -> DataFrame:
    """Clauses on liability with the phrase, and what to write instead."""
    fixed = F.regexp_replace("text", f"(?i){PHRASE}", "liability capped at the fees paid")
    return slices.where((F.col("category") == "liability") & _risky()).select("doc_id", "clause_no", fixed.alias("suggestion"))


def missing_clauses(template: DataFrame, slices: DataFrame) -> DataFrame:
    """(doc_id, category) of template categories that a document lacks."""
    from ..operators.retrieval import _small

    wanted = slices.select("doc_id").distinct().join(_small(template.select("category").distinct()))
    return wanted.join(slices.select("doc_id", "category").distinct(), ["doc_id", "category"], "left_anti")
