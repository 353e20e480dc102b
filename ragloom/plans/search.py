"""Hybrid search over a batch of queries as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 10, semantic: float = 0.5, per_source: int = 0) -> DataFrame:
    """Vector and keyword top 5k, fused by reciprocal ranks, boosted by words, capped by source, cut to k."""
    pool, semantic = 5 * k, min(max(semantic, 0.0), 1.0)
    vec = R.vector_top_k(queries.select("query_id", "qv"), vectors, pool).select("query_id", "chunk_id", "rank", F.lit(semantic).alias("weight"))
    key = R.bm25_top_k(queries.select("query_id", "query"), chunks, pool).select("query_id", "chunk_id", "rank", F.lit(1 - semantic).alias("weight"))
    fused = R.rrf(vec.unionByName(key), pool).drop("rank")
    full = fused.join(chunks.select("chunk_id", "source_id", "text"), "chunk_id").join(R._small(queries.select("query_id", "query")), "query_id")
    return R.top_k(R.cap_per_source(R.lexical_boost(full), per_source), k).select("query_id", "rank", "chunk_id", "source_id", "score", "hit_source")
