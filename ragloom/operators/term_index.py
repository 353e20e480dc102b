"""A term index kept on disk: postings in blocks by term, read for the terms of a question alone.

postings/bucket=B/ holds blocks of up to BLOCK postings of one term, in order of chunk_id: the chunks, how often
each has the term, how long each is, and the greatest count and the least length of the block. terms/bucket=B/
has for each term the number of its chunks and, for the HEADS best of them by the BM25 of one occurrence
counted, their partial scores. A term is the 64-bit hash of a token. Postings are sorted by (bucket, term,
chunk_id) over range partitions, so a frequent term is many blocks of many tasks and none is held whole.

top_k() reads the buckets of the query terms, and of those the rows of these terms. The k-th best partial score
of any one term is a floor of a query's k-th best score. A term, and a block, whose upper bound together with
those of the query's lesser terms stays below the floor cannot bring a chunk into the top k by itself: such
postings are read only for chunks that others have brought up. The result is that of retrieval.bm25_top_k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import shared_folder
from . import retrieval as R

BUCKETS, BLOCK, HEADS = 64, 128, 100
K1, B = 1.2, 0.75
#: Scores are rounded to 6 digits; bounds leave more than that.
MARGIN = 1e-5


def _counts(id_type: str):
    """(term, chunk_id, tf, size) of rows (chunk_id, tokens), and a row of term null for each chunk."""

    def run(batches):
        import pyarrow as pa

        for batch in R.token_slices(batches):
            flat, doc, many = R._flat(batch)
            order = np.lexsort((flat, doc))
            flat, doc = flat[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])])) if len(flat) else np.zeros(0, np.int64)
            tf = np.diff(np.concatenate([first, [len(flat)]]))
            rows = np.concatenate([doc[first], np.arange(batch.num_rows)])
            terms = pa.chunked_array([pa.array(flat[first], pa.int64()), pa.nulls(batch.num_rows, pa.int64())]).combine_chunks()
            sizes = pa.array(many[rows], pa.int32())
            tfs = pa.array(np.concatenate([tf, np.zeros(batch.num_rows, np.int64)]), pa.int32())
            yield pa.RecordBatch.from_arrays([terms, batch.column(0).take(pa.array(rows)), tfs, sizes], names=["term", "chunk_id", "tf", "size"])

    return run, f"term long, chunk_id {id_type}, tf int, size int"


def _cut(block: int):
    """Blocks of rows (term, chunk_id, tf, size) in order of term."""

    def blocks(pa, t):
        term = t.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]])
        at = np.concatenate([np.arange(a, b, block) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        off = pa.array(np.concatenate([at, [len(term)]]).astype(np.int32))
        tf, size = (t.column(k).to_numpy() for k in (2, 3))
        lists = [pa.ListArray.from_arrays(off, t.column(k)) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(term[at]), *lists, pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(size, at))], names=["term", "chunks", "tfs", "sizes", "most", "least"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield blocks(pa, batch)

    return run


@dataclass
class TermIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str, tokens=T.words, k1: float = K1, b: float = B) -> TermIndex:
        """Writes the index of chunks (chunk_id, text), or (chunk_id, tokens) made by retrieval.postings()."""
        own = chunks if "tokens" in chunks.columns else R.postings(chunks, tokens(F.col("text")))
        run, schema = _counts(own.schema["chunk_id"].dataType.simpleString())
        spark = chunks.sparkSession
        held = shared_folder(spark, "counts")
        own.select("chunk_id", "tokens").mapInArrow(run, schema).write.parquet(held)
        counts = spark.read.parquet(held)
        counts.where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg")).write.mode("overwrite").parquet(f"{path}/sizes")
        avg = spark.read.parquet(f"{path}/sizes").first()["avg"]
        bucket = F.pmod("term", F.lit(BUCKETS)).cast("int").alias("bucket")
        posted = counts.where("term is not null")
        ordered = posted.repartitionByRange(bucket, "term", "chunk_id").sortWithinPartitions(bucket, "term", "chunk_id")
        kind = own.schema["chunk_id"].dataType.simpleString()
        cut = ordered.mapInArrow(_cut(BLOCK), f"term long, chunks array<{kind}>, tfs array<int>, sizes array<int>, most int, least int")
        cut.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / max(avg, 1e-12)))
        best = Window.partitionBy("term").orderBy(F.desc("part"))
        heads = posted.withColumn("part", part).withColumn("r", F.row_number().over(best)).where(F.col("r") <= HEADS)
        heads = heads.groupBy("term").agg(F.sort_array(F.collect_list("part"), asc=False).alias("heads"))
        terms = posted.groupBy("term").agg(F.count("*").alias("df")).join(heads, "term")
        terms.withColumn("bucket", bucket).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        return cls(spark, path)

    def _read(self, name: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets))

    def plan(self, queries: DataFrame, k: int, tokens=T.words) -> tuple[DataFrame, list[int]]:
        """Query terms (query_id, bucket, term, weight, bound, rest, floor), and the buckets they are in, BUCKETS at most.

        bound: the most that the term adds to a score; rest: that of the query's lesser terms; floor: what the k-th
        best score is at least.
        """
        asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("t")).groupBy("query_id", F.xxhash64("t").alias("term")).agg(F.count("*").alias("times"))
        asked = asked.withColumn("bucket", F.pmod("term", F.lit(BUCKETS)).cast("int"))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
        n = self.spark.read.parquet(f"{self.path}/sizes").first()["n"]
        terms = asked.join(self._read("terms", buckets), ["bucket", "term"])
        idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        terms = terms.withColumn("weight", F.col("times") * idf).withColumn("bound", F.col("weight") * F.get("heads", F.lit(0)))
        every = Window.partitionBy("query_id")
        lesser = every.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, -1)
        kth = F.coalesce(F.col("weight") * F.get("heads", F.lit(k - 1)), F.lit(0.0)) if k <= HEADS else F.lit(0.0)
        out = terms.withColumn("rest", F.coalesce(F.sum("bound").over(lesser), F.lit(0.0))).withColumn("floor", F.max(kth).over(every) - MARGIN)
        return out.select("query_id", "bucket", "term", "weight", "bound", "rest", "floor"), buckets

    def top_k(self, queries: DataFrame, k: int, tokens=T.words, k1: float = K1, b: float = B) -> DataFrame:
        """BM25 top-k of queries (query_id, query): (query_id, chunk_id, score, rank)."""
        asked, buckets = self.plan(queries, k, tokens)
        asked = R._small(asked)
        avg = max(self.spark.read.parquet(f"{self.path}/sizes").first()["avg"], 1e-12)
        part = lambda tf, size: F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg))
        blocks = self._read("postings", buckets).join(asked, ["bucket", "term"])
        one = F.explode(F.arrays_zip("chunks", "tfs", "sizes")).alias("x")
        scored = lambda df: df.select("query_id", one, "weight").select("query_id", F.col("x.chunks").alias("chunk_id"), part(F.col("x.tfs"), F.col("x.sizes")).alias("part"))
        # a block counts by itself if its best posting, with all lesser terms, may reach the floor
        alone = part(F.col("most"), F.col("least")) + F.col("rest") >= F.col("floor")
        brought = scored(blocks.where(alone))
        others = scored(blocks.where(~alone)).join(brought.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
        total = brought.unionByName(others).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
        return R.top_k(total, k)
