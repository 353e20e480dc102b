"""Many patterns in many texts: which of a table of strings stand in the head of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import _small

#: Characters of a pattern that texts are joined by; shorter patterns are joined whole.
KEY = 3


def contained(texts: DataFrame, patterns: DataFrame, key: str, head: int) -> DataFrame:
    """(key, term): terms of patterns that stand in the first `head` characters of text, each once a row of texts (key, text).

    Each head gives its distinct runs of the patterns' key lengths (KEY at most), an equi-join by them finds the
    patterns that may begin there, and each such pair is verified on the head. The empty string is in every text that
    is not null, and is not asked for here.
    """
    terms = patterns.select("term").where("term <> ''").distinct()
    keyed = terms.withColumn("gram", F.substring("term", 1, KEY)).withColumn("size", F.length("gram"))
    sizes = [r[0] for r in keyed.select("size").distinct().collect()]  # KEY at most
    heads = texts.select(key, F.substring("text", 1, head).alias("head"))

    def runs(n: int):
        last = F.length("head") - (n - 1)
        return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("head"), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[runs(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    may = heads.select(key, F.explode(every).alias("gram")).join(_small(keyed.select("gram", "term")), "gram").select(key, "term")
    # the verification goes back to the heads by key, so that no text rides along with its runs
    return heads.join(may, key).where(F.contains(F.col("head"), F.col("term"))).select(key, "term").distinct()
