"""Search and answering with every option of the engine, over batches of queries.

Parts that need a model plug in as functions of Columns: a rewriter gives variants, a reranker a score, a
generator a text. Without them the plan is the same, with those steps left out or stubs in their place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import boosts as B
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import signals as G
from ..operators.store import ChunkStore
from . import parts

#: Chunks that a summary is made from, and hits of a source in a comparison.
PER_SUMMARY, PER_COMPARED = 20, 2


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    semantic: float = 0.5
    adjust_weight: bool = False
    variant_weight: float = 0.7
    most_variants: int = 0
    variant_overlap: float = 0.0
    drop_noise: bool = True
    caption_alpha: float = 0.0
    caption_idf: bool = False
    heading_alpha: float = 0.0
    inject: int = 0
    lexical_alpha: float = 0.5
    per_source: int = 0
    rerank_weight: float = 0.0
    rerank_top: int = 20


@dataclass(frozen=True)
class Engine:
    """chunks: (chunk_id, source_id, ord, text, heading_path); vectors: (chunk_id, v)."""

    chunks: DataFrame
    vectors: DataFrame
    embed: Callable[[Column], Column] | None = None
    rewrite: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    generate: Callable[[Column], Column] = field(default=parts.echo)
    tokens: Callable[[Column], Column] = T.words
    classify: Callable[[Column], Column] = field(default=parts.IntentClassifier().column)
    compress: Callable[[Column, Column], Column] | None = None
    meta: DataFrame | None = None

    @classmethod
    def of_store(cls, store: ChunkStore, notebook: str | None = None, sources: DataFrame | None = None, **rest) -> Engine:
        """An engine over what a store holds of a notebook and a scope of sources."""
        c = store._scope(notebook, sources)
        return cls(c.select("chunk_id", "source_id", "ord", "text", "heading_path"), c.where("embedding is not null").select("chunk_id", F.col("embedding").alias("v")), **rest)

    def auto(self, options: SearchOptions) -> SearchOptions:
        """Options with heading boosts and one hit per source switched on where the corpus asks for them."""
        x = G.auto_options(self.chunks).first()
        return SearchOptions(**{**options.__dict__, "heading_alpha": options.heading_alpha or (0.1 if x["heading_boost"] else 0.0), "per_source": options.per_source or x["per_source"]})

    def variants(self, queries: DataFrame, o: SearchOptions) -> DataFrame:
        """(query_id, variant_no, query, qv, weight); number 0 is the query itself."""
        own = queries.withColumn("variant_no", F.lit(0)).withColumn("weight", F.lit(1.0))
        if not o.most_variants or self.rewrite is None:
            return own
        more = queries.select("query_id", F.posexplode(P.query_variants(F.col("query"), self.rewrite(F.col("query")), o.most_variants)).alias("variant_no", "query")).where("variant_no > 0")
        more = more.withColumn("qv", self.embed(F.col("query"))) if self.embed else more.join(queries.select("query_id", "qv"), "query_id")
        all_of = own.unionByName(more.withColumn("weight", F.lit(o.variant_weight)))
        if o.variant_overlap > 0:
            captions = self.chunks.select(T.caption_or_lead(F.col("text")).alias("caption")).where("caption is not null")
            all_of = B.variant_filter(all_of, captions, o.variant_overlap)
        return all_of

    def pool(self, queries: DataFrame, o: SearchOptions) -> DataFrame:
        """Vector and keyword rankings of all variants, fused by weighted reciprocal ranks."""
        v = self.variants(queries, o).withColumn("vid", F.concat_ws("/", "query_id", "variant_no"))
        base = T.hybrid_weight(F.col("query"), o.semantic) if o.adjust_weight else F.lit(min(max(o.semantic, 0.0), 1.0))
        v = v.withColumn("semantic", base)
        n = 5 * o.k
        vec = R.vector_top_k(v.select(F.col("vid").alias("query_id"), "qv"), self.vectors, n).withColumn("kind", F.lit("vector"))
        key = R.bm25_top_k(v.select(F.col("vid").alias("query_id"), "query"), self.chunks, n, self.tokens).withColumn("kind", F.lit("keyword"))
        both = vec.select("query_id", "chunk_id", "rank", "kind").unionByName(key.select("query_id", "chunk_id", "rank", "kind"))
        both = both.withColumnRenamed("query_id", "vid").join(v.select("vid", "query_id", "weight", "semantic"), "vid")
        if o.drop_noise:
            clean = self.chunks.where(~T.is_retrieval_noise(F.col("text"))).select("chunk_id")
            both = both.join(clean, "chunk_id", "left_semi")
            both = R.top_k(both.withColumn("by", F.concat_ws("/", "vid", "kind")).withColumn("score", -F.col("rank")), n, by="by")
        share = F.when(F.col("kind") == "vector", F.col("semantic")).otherwise(1 - F.col("semantic"))
        return R.rrf(both.withColumn("weight", F.col("weight") * share), n).drop("rank")

    def search(self, queries: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
        """(query_id, rank, chunk_id, source_id, score, hit_source) of queries (query_id, query, qv)."""
        pool = self.pool(queries, o)
        own = queries.select("query_id", "query")
        captions = self.chunks.select("chunk_id", T.caption_or_lead(F.col("text")).alias("caption")).where("caption is not null")
        idf = R.caption_idf(captions) if o.caption_idf else None
        if o.inject:
            kinds = pool.select("query_id", "chunk_id", "hit_source")
            pool = B.index_inject(pool, own, captions, o.inject, o.caption_alpha or 0.1, idf).join(kinds, ["query_id", "chunk_id"], "left").withColumn("hit_source", F.coalesce("hit_source", F.lit("caption")))
        hits = pool.select("query_id", "chunk_id", "score", "hit_source").join(self.chunks.select("chunk_id", "source_id", "text", "heading_path"), "chunk_id").join(own, "query_id")
        hits = B.caption_boost(hits, o.caption_alpha, idf) if o.caption_alpha > 0 else hits
        hits = B.heading_boost(hits, o.heading_alpha) if o.heading_alpha > 0 else hits
        hits = R.lexical_boost(hits, o.lexical_alpha) if o.lexical_alpha > 0 else hits
        if self.meta is not None:
            hits = B.source_meta_boost(hits, self.meta, F.unix_millis(F.current_timestamp()))
        hits = R.cap_per_source(hits, o.per_source)
        if o.rerank_weight > 0 and self.rerank is not None and not o.most_variants:
            ranked = R.top_k(hits, 5 * o.k).withColumn("ce", self.rerank(F.col("query"), F.col("text")))
            hits = B.rerank_blend(ranked, o.rerank_weight, o.rerank_top).drop("rank").withColumnRenamed("new_rank", "rank").where(F.col("rank") <= o.k)
        else:
            hits = R.top_k(hits, o.k)
        return hits.select("query_id", "rank", "chunk_id", "source_id", "score", "hit_source")

    def sources_of(self, queries: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
        """(query_id, rank, chunk_id, text) that queries (query_id, query, qv, intent) are answered from.

        lookup: the hits of search; compare: those with at most two a source; summary: the first chunks of the
        sources in scope, PER_SUMMARY of them in order of source and position; smalltalk: none.
        """
        asked = queries.select("query_id", "query", "qv")
        by = lambda *kinds: asked.join(queries.where(F.col("intent").isin(*kinds)).select("query_id"), "query_id", "left_semi")
        found = self.search(by("lookup"), o).unionByName(self.search(by("compare"), replace(o, per_source=PER_COMPARED)))
        first = R.representatives(self.chunks, PER_SUMMARY).orderBy("source_id", "ord", "chunk_id").limit(PER_SUMMARY).agg(F.collect_list("chunk_id").alias("ids"))
        ids = first.first()["ids"]  # PER_SUMMARY at most
        kind = self.chunks.schema["chunk_id"].dataType
        listed = F.array(*[F.lit(i) for i in ids]).cast(f"array<{kind.simpleString()}>")
        summary = by("summary").select("query_id", F.posexplode(listed).alias("rank", "chunk_id")).withColumn("rank", F.col("rank") + 1)
        every = found.select("query_id", "rank", "chunk_id").unionByName(summary)
        got = every.join(self.chunks.select("chunk_id", "text"), "chunk_id").join(R._small(queries.select("query_id", "query")), "query_id")
        text = F.when(self.compress(F.col("query"), F.col("text")) != "", self.compress(F.col("query"), F.col("text"))).otherwise(F.col("text")) if self.compress else F.col("text")
        return got.select("query_id", "rank", "chunk_id", text.alias("text"))

    def ask(self, queries: DataFrame, o: SearchOptions = SearchOptions(), least_support: float = 0.5) -> DataFrame:
        """(query_id, intent, context, answer, total, unsupported, ratio, reliable).

        An answer without any citation, though there were hits, is generated once more with a stricter
        prompt; reliable says whether few enough citations lack support.
        """
        known = queries.withColumn("intent", self.classify(F.col("query")))
        hits = self.sources_of(known, o)
        context = P.context_block(hits)
        rows = known.select("query_id", "query", "intent").join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        prompt = lambda rule: F.concat(F.lit(rule), F.col("context"), F.lit("\n"), F.col("query"))
        first = self.generate(prompt("Answer from the sources and cite them as [n].\n"))
        again = self.generate(prompt("Cite a source as [n] after every sentence.\n"))
        got = rows.withColumn("first", P.cut_at_stop(first))
        bare = (F.size(T.citation_ids(F.col("first"))) == 0) & (F.col("context") != "")
        got = got.withColumn("answer", F.when(bare, P.cut_at_stop(again)).otherwise(F.col("first"))).drop("first")
        checked = E.verify_citations(got.select("query_id", "answer"), hits.select("query_id", "rank", "text"))
        return got.join(checked, "query_id").withColumn("reliable", F.col("ratio") < least_support)
