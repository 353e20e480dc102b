"""Score adjustments of hits (query_id, query, chunk_id, text, score): captions, headings, words, metadata, rerankers.

Each takes and returns one DataFrame, so several of them chain into one plan; ranks are taken afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R

#: Overlaps below this do not count.
LEAST_OVERLAP = 0.10


def overlap(query: Column, caption: Column) -> Column:
    return T.jaccard(T.bigrams(query), T.bigrams(caption))


def _best(query: Column, items: Column) -> Column:
    found = T.let(T.bigrams(query), lambda q: F.array_max(F.transform(items, lambda x: T.jaccard(q, T.bigrams(x)))))
    return F.coalesce(found, F.lit(0.0))


def caption_boost(hits: DataFrame, alpha: float, idf: DataFrame | None = None) -> DataFrame:
    """score += alpha * the better of caption overlap (times its idf) and defined-term overlap; floors on raw overlaps.

    idf: (caption, idf); captions that it lacks weigh 1.
    """
    own = hits.withColumn("cap", T.caption_or_lead(F.col("text")))
    own = own.join(idf.select(F.col("caption").alias("cap"), F.col("idf").alias("w")), "cap", "left") if idf is not None else own.withColumn("w", F.lit(1.0))
    cap = F.when(F.col("cap").isNull(), 0.0).otherwise(overlap(F.col("query"), F.col("cap")))
    term = _best(F.col("query"), T.defined_terms(F.col("text")))
    own = own.withColumn("cap_overlap", cap).withColumn("term_overlap", term)
    part = lambda c, w: F.when(F.col(c) >= LEAST_OVERLAP, F.lit(alpha) * F.col(c) * w).otherwise(0.0)
    boost = F.greatest(part("cap_overlap", F.coalesce("w", F.lit(1.0))), part("term_overlap", F.lit(1.0)))
    return own.withColumn("score", F.round(F.col("score") + boost, 9)).drop("cap", "w", "cap_overlap", "term_overlap")


def heading_boost(hits: DataFrame, alpha: float) -> DataFrame:
    """score += alpha * the best overlap with a segment of heading_path; no floor."""
    return hits.withColumn("score", F.round(F.col("score") + F.lit(alpha) * _best(F.col("query"), F.coalesce("heading_path", F.array().cast("array<string>"))), 9))


def index_inject(hits: DataFrame, queries: DataFrame, index: DataFrame, n: int, alpha: float, idf: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the pool plus alpha * overlap for the n best entries of index (chunk_id, caption).

    Entries that the pool lacks join it with their bonus alone. Entries of one caption score alike, so the n least of
    each caption, for the captions that fewer than n better, are all that is joined.
    """
    pairs = R.caption_join(queries, index.select("caption").distinct(), LEAST_OVERLAP)  # no idf is above 1
    if idf is not None:
        pairs = pairs.join(idf.select("caption", "idf"), "caption", "left").withColumn("overlap", F.col("overlap") * F.coalesce("idf", F.lit(1.0)))
    near = Window.partitionBy("query_id").orderBy(F.desc("overlap"))
    pairs = pairs.where(F.col("overlap") >= LEAST_OVERLAP).withColumn("better", F.rank().over(near)).where(F.col("better") <= n).drop("better")
    first = Window.partitionBy("caption").orderBy("chunk_id")
    entries = index.select("chunk_id", "caption").withColumn("r", F.row_number().over(first)).where(F.col("r") <= n).drop("r")
    best = R.top_k(pairs.join(entries, "caption"), n, "overlap")
    bonus = best.select("query_id", "chunk_id", (F.lit(alpha) * F.col("overlap")).alias("score"))
    return hits.select("query_id", "chunk_id", "score").unionByName(bonus).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))


def source_meta_boost(hits: DataFrame, meta: DataFrame, now_ms: Column, title: bool = True, recency: bool = True) -> DataFrame:
    """score *= 1 + 0.15 for a title match + 0.10 under 7 days or 0.05 under 30; meta: (source_id, title, created_at_ms)."""
    own = hits.join(meta.select("source_id", F.lower("title").alias("meta_title"), "created_at_ms"), "source_id", "left")
    q = F.lower("query")
    named = F.exists(T.extract_terms(F.col("query")), lambda t: F.contains(F.col("meta_title"), t)) | ((F.length(q) >= 3) & F.contains(F.col("meta_title"), q))
    age = F.greatest(now_ms - F.col("created_at_ms"), F.lit(0)) / F.lit(86_400_000)
    recent = F.when(F.col("created_at_ms") > 0, F.when(age < 7, 0.10).when(age < 30, 0.05).otherwise(0.0)).otherwise(0.0)
    boost = (F.when(named, 0.15).otherwise(0.0) if title else F.lit(0.0)) + (recent if recency else F.lit(0.0))
    return own.withColumn("score", F.round(F.col("score") * (1 + F.coalesce(boost, F.lit(0.0))), 9)).drop("meta_title", "created_at_ms")


def rerank_blend(hits: DataFrame, weight: float, n: int) -> DataFrame:
    """Of hits (query_id, chunk_id, rank, score, ce): the first n reordered by weight * ce + (1 - weight) * scaled score.

    Scores are scaled by the largest absolute one among the n, floored at 1e-6, into 0..1. Later ranks keep
    their place; with one hit nothing changes.
    """
    head = F.col("rank") <= n
    by = Window.partitionBy("query_id")
    top = F.greatest(F.max(F.when(head, F.abs("score"))).over(by), F.lit(1e-6))
    scaled = F.greatest(F.least(F.col("score") / top, F.lit(1.0)), F.lit(0.0))
    many = F.sum(head.cast("int")).over(by) > 1
    own = hits.withColumn("blend", F.when(head & many, F.round(F.lit(weight) * F.col("ce") + F.lit(1 - weight) * scaled, 9)))
    order = Window.partitionBy("query_id").orderBy((~head).cast("int"), F.desc("blend"), "rank")
    return own.withColumn("new_rank", F.row_number().over(order)).withColumn("score", F.coalesce("blend", "score")).drop("blend")


def score_max(rankings: DataFrame) -> DataFrame:
    """The best score of each chunk over all rankings, the alternative to reciprocal ranks."""
    return rankings.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def variant_filter(variants: DataFrame, captions: DataFrame, least: float) -> DataFrame:
    """Variants (query_id, variant_no, query): number 0 stays, others only with a caption overlap of least or more."""
    v = variants.withColumn("key", F.concat_ws("/", "query_id", "variant_no"))
    near = R.caption_join(v.select(F.col("key").alias("query_id"), "query"), captions.select("caption").distinct(), least)
    return v.join(near.select(F.col("query_id").alias("key")).distinct().withColumn("near", F.lit(True)), "key", "left").where("variant_no = 0 or near").drop("key", "near")
