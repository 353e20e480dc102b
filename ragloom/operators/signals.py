"""Signals of a corpus and of its queries that options are chosen by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R

#: Chunks that the vocabulary signals look at, by position.
SAMPLE = 256
ENRICH_BELOW, ENRICH_UP_TO = 0.30, 0.40


def body_recall(queries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(query_id, recall): the largest share of a query's bigrams that one body (chunk_id, text) holds; 0 if none."""
    q = queries.select("query_id", T.bigrams(F.col("query")).alias("grams"))
    shared = R.shared_grams(q, bodies.select("chunk_id", T.bigrams(F.col("text")).alias("grams")), "chunk_id")
    best = shared.groupBy("query_id").agg(F.max(F.col("both") / F.col("nq")).alias("recall"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def title_match(queries: DataFrame, chunks: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(query_id, recall) against the last headings of the first n chunks that have one."""
    own = chunks.withColumn("text", F.trim(F.try_element_at("heading_path", F.lit(-1)))).where("text <> ''")
    return body_recall(queries, sample(own, n))


def recall_mean(queries: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row: the mean over all queries; 0 without queries."""
    return body_recall(queries, bodies).agg(F.coalesce(F.round(F.avg("recall"), 9), F.lit(0.0)).alias("recall"))


def sample(chunks: DataFrame, n: int = SAMPLE) -> DataFrame:
    return chunks.orderBy("ord", "chunk_id").limit(n)


def recommend_enrichment(mean: Column) -> Column:
    """on below the lower bound, off above the upper one, uncertain between."""
    return F.when(mean < ENRICH_BELOW, "on").when(mean < ENRICH_UP_TO, "uncertain").otherwise("off")


def density(chunks: DataFrame) -> DataFrame:
    """One row of n_chunks, the share of chunks with a caption and of those with a telling heading.

    A heading tells if its joined path has 8 characters or more and one that is not ASCII.
    """
    head = F.concat_ws(" ", "heading_path")
    telling = (F.length(head) >= 8) & head.rlike(r"[^\x00-\x7F]")
    share = lambda x: F.coalesce(F.round(F.avg(x.cast("double")), 9), F.lit(0.0))
    return chunks.agg(F.count("*").alias("n_chunks"), share(T.caption_or_lead(F.col("text")).isNotNull()).alias("caption_density"), share(telling).alias("heading_density"))


def paraphrase_score(chunks: DataFrame, n: int = SAMPLE) -> DataFrame:
    """Mean novelty of bodies against their captions over the first n chunks that have one; 0 if none."""
    c = chunks.withColumn("cap", T.caption_or_lead(F.col("text"))).where("cap is not null")
    at = F.instr("text", F.col("cap"))
    body = F.concat(F.substring("text", F.lit(1), at - 1), F.substring("text", at + F.length("cap"), F.length("text")))
    return sample(c, n).agg(F.coalesce(F.round(F.avg(T.novelty(T.bigrams(body), T.bigrams(F.col("cap")))), 9), F.lit(0.0)).alias("novelty"))


def caption_length(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.length(T.caption_or_lead(F.col("text"))).alias("n")).where("n > 0").agg(F.coalesce(F.round(F.avg("n"), 9), F.lit(0.0)).alias("caption_len_mean"))


def tokenizer_signals(chunks: DataFrame, dictionary: bool = False) -> DataFrame:
    """Characters, share of ASCII letters, kinds of digits; the choice rests on the dictionary alone."""
    t = F.col("text")
    count = F.coalesce(F.sum(F.length(t)), F.lit(0))
    letters = F.sum(F.regexp_count(t, F.lit("[A-Za-z]")))
    has = lambda p: F.coalesce(F.bool_or(t.rlike(p)), F.lit(False))
    return chunks.agg(
        count.alias("total_chars"), F.round(F.coalesce(F.try_divide(letters, count), F.lit(0.0)), 9).alias("en_ratio"),
        has("[０-９]").alias("has_wide_digit"), has("[一二三四五六七八九十百千万〇零]").alias("has_kanji_digit"),
        F.lit("morpheme_nfkc" if dictionary else "bigram_nfkc").alias("tokenizer"),
    )


def specific_ratio(queries: DataFrame) -> DataFrame:
    return queries.agg(F.coalesce(F.round(F.avg(T.is_specific_query(F.col("query")).cast("double")), 9), F.lit(0.0)).alias("ratio"))


def golden_granularity(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """doc if all relevant ids are documents, parent if all are parents, else doc."""
    ids = golden.select("relevant_id").distinct()
    doc = corpus.select(F.col("doc_id").alias("relevant_id")).distinct().withColumn("d", F.lit(True))
    parent = corpus.where("parent_id is not null").select(F.col("parent_id").alias("relevant_id")).distinct().withColumn("p", F.lit(True))
    j = ids.join(doc, "relevant_id", "left").join(parent, "relevant_id", "left")
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    return j.agg(F.when(every("d"), "doc").when(every("p"), "parent").otherwise("doc").alias("granularity"))


def missing_golden(golden: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """Relevant ids that the corpus lacks."""
    return golden.join(corpus_ids.select(F.col("doc_id").alias("relevant_id")), "relevant_id", "left_anti")


def auto_options(chunks: DataFrame) -> DataFrame:
    """One row: whether heading boosts and one hit per source pay off on this corpus."""
    d = density(chunks).select("heading_density")
    s = chunks.agg(F.countDistinct("source_id").alias("n"))
    return d.join(s).select((F.col("heading_density") >= 0.8).alias("heading_boost"), F.when(F.col("n") >= 3, 1).otherwise(0).alias("per_source"))
