"""Retrieval metrics and citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from .retrieval import _small, rrf


#: Relevant pairs (query_id, relevant_id), or the labels of queries (query_id, label) and of items (relevant_id, label):
#: items of a query's label are relevant to it, and the pairs, as many as queries times items of a label, are never made.
Golden = DataFrame | tuple[DataFrame, DataFrame]


def _relevant(hits: DataFrame, golden: Golden) -> tuple[DataFrame, DataFrame]:
    """(query_id, n): the number of relevant rows of each query that has any; and the hits that are relevant."""
    if isinstance(golden, DataFrame):
        rel = golden.select("query_id", F.col("relevant_id").alias("chunk_id")).distinct()
        return rel.groupBy("query_id").agg(F.count("*").alias("n")), hits.join(rel, ["query_id", "chunk_id"], "left_semi")
    queries, items = (df.select(F.col(x).alias(y), "label").where("label is not null").distinct() for df, x, y in zip(golden, ("query_id", "relevant_id"), ("query_id", "chunk_id"), strict=True))
    one = queries.join(items.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", "n")
    # an item and a query that share several labels are one pair
    several = lambda df, x: df.groupBy(x).agg(F.collect_set("label").alias("labels")).where(F.size("labels") > 1).select(x, F.explode("labels").alias("label"))
    again = several(queries, "query_id").join(several(items, "chunk_id"), "label").groupBy("query_id", "chunk_id").agg((1 - F.count("*")).alias("n")).select("query_id", "n")
    size = one.unionByName(again).groupBy("query_id").agg(F.sum("n").alias("n"))
    rel = hits.select("query_id", "chunk_id").distinct().join(queries, "query_id").join(items, ["chunk_id", "label"]).select("query_id", "chunk_id").distinct()
    return size, hits.join(rel, ["query_id", "chunk_id"], "left_semi")


def metrics(hits: DataFrame, golden: Golden, k: int) -> DataFrame:
    """Per query recall, hit and nDCG at k, and reciprocal rank over the whole list; no relevant rows: 1."""
    size, found = _relevant(hits, golden)
    top = F.col("rank") <= k
    agg = found.groupBy("query_id").agg(F.sum(top.cast("int")).alias("m"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("best"))
    all_q = hits.select("query_id").union(size.select("query_id")).distinct()
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = all_q.join(size, "query_id", "left").join(agg, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    empty = F.col("n").isNull()
    return j.select("query_id", F.when(empty, 1.0).otherwise(zero(F.col("m") / F.col("n"))).alias("recall"), F.when(empty, 1.0).otherwise(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("hit"), F.when(empty, 1.0).otherwise(F.round(zero(F.col("dcg") / ideal), 9)).alias("ndcg"), F.when(empty, 1.0).otherwise(zero(1 / F.col("best"))).alias("rr"))


def summarise(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hit", "ndcg", "rr")])


def verify_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Per answer: markers, those that point to no hit or whose sentence shares no words with it, and their ratio.

    A sentence without words cannot be judged and counts as supported.
    """
    marks = answers.select("query_id", "answer", F.explode(T.citation_marks(F.col("answer"))).alias("m"))
    marks = marks.select("query_id", F.col("m.n").alias("rank"), T.overlap_tokens(T.surrounding_sentence(F.col("answer"), F.col("m.at"))).alias("said"))
    j = marks.join(hits.select("query_id", "rank", "text"), ["query_id", "rank"], "left")
    bad = F.col("text").isNull() | ((F.size("said") > 0) & (T.containment(F.col("said"), T.overlap_tokens(F.col("text"))) < 0.05))
    got = j.groupBy("query_id").agg(F.count("*").alias("total"), F.sum(bad.cast("int")).alias("unsupported"))
    return answers.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"), F.coalesce(F.try_divide("unsupported", "total"), F.lit(0.0)).alias("ratio"))


#: Characters that do not count for faithfulness.
IGNORED = r"""[、。・「」『』（）【】,.;:!?()\[\]"']"""


def faithfulness(answer, contexts):
    """Share of the answer's bigrams found in the contexts; 1 for an empty answer or a refusal."""
    bare = lambda x: T.bigrams(F.regexp_replace(x, IGNORED, ""))
    a = bare(answer)
    return F.when((F.size(a) == 0) | P.looks_like_refusal(answer), 1.0).otherwise(T.containment(a, bare(contexts)))


def faithfulness_summary(scores: DataFrame) -> DataFrame:
    """Mean, least and largest score; zeros without rows."""
    zero = lambda c: F.coalesce(F.round(c, 9), F.lit(0.0))
    return scores.agg(zero(F.avg("score")).alias("mean"), zero(F.min("score")).alias("low"), zero(F.max("score")).alias("high"))


def citation_spans(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank, sentence, overlap): per marker the sentence of the hit that is nearest to the answer's."""
    marks = answers.select("query_id", F.explode(T.sentences(F.col("answer"))).alias("said")).select("query_id", "said", F.explode(T.citation_ids(F.col("said"))).alias("rank"))
    own = hits.select("query_id", "rank", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    j = marks.join(own, ["query_id", "rank"]).withColumn("overlap", F.round(T.jaccard(T.overlap_tokens(F.col("said")), T.overlap_tokens(F.col("sentence"))), 9))
    best = F.max_by(F.struct("sentence", "overlap"), F.struct("overlap", (-F.col("at")).alias("at")))
    return j.groupBy("query_id", "rank", "said").agg(best.alias("x")).select("query_id", "rank", "said", "x.sentence", "x.overlap")


def weight_sweep(runs: DataFrame, golden: Golden, k: int) -> DataFrame:
    """Mean metrics of each run (run_id, query_id, chunk_id, rank) over the golden queries."""
    keyed = runs.withColumn("query_id", F.struct("run_id", "query_id"))
    asked, items = (golden, None) if isinstance(golden, DataFrame) else golden
    wanted = asked.join(_small(runs.select("run_id").distinct()))
    wanted = wanted.select(F.struct("run_id", "query_id").alias("query_id"), *[x for x in asked.columns if x != "query_id"])
    per = metrics(keyed, wanted if items is None else (wanted, items), k)
    return per.groupBy(F.col("query_id.run_id").alias("run_id")).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hit", "ndcg", "rr")])


def weight_grid(vectors: DataFrame, keywords: DataFrame, golden: Golden, weights: list[float], k: int) -> DataFrame:
    """(semantic, queries, recall, hit, ndcg, rr): mean metrics of hybrid search at each semantic weight.

    vectors and keywords are the two rankings (query_id, chunk_id, rank) of one retrieval: every weight fuses and
    scores the same ranks, exploded over the grid, in one job. Weights are clamped to 0 .. 1; one of 0 leaves its
    ranking out. Golden queries without hits count.
    """
    grid = F.explode(F.array(*[F.lit(min(max(float(w), 0.0), 1.0)) for w in dict.fromkeys(weights)])).alias("semantic")
    keyed = lambda df, *columns: df.select("*", grid).select(F.struct("semantic", "query_id").alias("query_id"), *columns)
    ranked = keyed(vectors, "chunk_id", "rank", F.col("semantic").alias("weight")).unionByName(keyed(keywords, "chunk_id", "rank", (1 - F.col("semantic")).alias("weight")))
    wanted = keyed(golden, "relevant_id") if isinstance(golden, DataFrame) else (keyed(golden[0], "label"), golden[1])
    per = metrics(rrf(ranked, k), wanted, k)
    means = [F.round(F.avg(x), 6).alias(x) for x in ("recall", "hit", "ndcg", "rr")]
    return per.groupBy(F.col("query_id.semantic").alias("semantic")).agg(F.count("*").alias("queries"), *means)
