"""Substring search by an index of byte trigrams, kept on disk.

grams/bucket=B/ holds, for each trigram of the UTF-8 bytes of a lower-cased text, the chunks that have it, in blocks
sorted by (gram, chunk_id) over range partitions; counts/bucket=B/ the number of chunks of each. The bucket is
a gram's first byte. A text holds a query only if it has all the query's grams: candidates are the chunks that
have its RAREST rarest ones, and each is verified on its text. A text is indexed with two bytes of 0 behind it, so
a query of one or two bytes is looked up by the range of grams that it begins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..sources.scratch import shared_folder
from . import retrieval as R

BLOCK, RAREST = 1024, 3
#: Bytes of text whose grams a task sorts at once.
SLICE_BYTES = 4_000_000


def _grams(id_type: str):
    """(gram, chunk_id): the distinct grams of each lower-cased text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                own = [(t or "").encode() + b"\0\0" for t in texts[at:end]]
                data = np.frombuffer(b"".join(own), dtype=np.uint8).astype(np.int64)
                doc = np.repeat(np.arange(at, end), [len(t) for t in own])
                gram = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
                inside = doc[2:] == doc[:-2]
                cells = np.unique(gram[inside] * len(texts) + doc[:-2][inside])
                yield pa.RecordBatch.from_arrays([pa.array((cells // len(texts)).astype(np.int32)), batch.column(0).take(pa.array(cells % len(texts)))], names=["gram", "chunk_id"])
                at = end

    return run, f"gram int, chunk_id {id_type}"


def _cut(batches):
    """Blocks (gram, chunks) of rows (gram, chunk_id) in order of gram."""
    import pyarrow as pa

    for batch in batches:
        gram = batch.column(0).to_numpy()
        if not len(gram):
            continue
        edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
        at = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        off = pa.array(np.concatenate([at, [len(gram)]]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.ListArray.from_arrays(off, batch.column(1))], names=["gram", "chunks"])


@dataclass
class GramIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> GramIndex:
        """Writes the index of chunks (chunk_id, text); a null text is in no result."""
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        run, schema = _grams(kind)
        held = shared_folder(chunks.sparkSession, "grams")
        chunks.where("text is not null").select("chunk_id", F.lower("text")).mapInArrow(run, schema).write.parquet(held)
        rows, bucket = chunks.sparkSession.read.parquet(held), F.shiftright("gram", 16).alias("bucket")
        ordered = rows.repartitionByRange("gram", "chunk_id").sortWithinPartitions("gram", "chunk_id")
        ordered.mapInArrow(_cut, f"gram int, chunks array<{kind}>").withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
        rows.groupBy("gram").agg(F.count("*").alias("df")).withColumn("bucket", bucket).repartitionByRange("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
        return cls(chunks.sparkSession, path)

    def _read(self, name: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id): chunks that have the rarest grams of queries (query_id, q) of a byte or more."""
        code = F.encode("q", "utf-8")
        size = F.octet_length("q")
        byte = lambda i: F.conv(F.hex(F.substring(code, i, F.lit(1))), 16, 10).cast("int")
        whole = F.transform(F.sequence(F.lit(1), size - 2), lambda i: byte(i) * 65536 + byte(i + 1) * 256 + byte(i + 2))
        one, two = byte(F.lit(1)) * 65536, byte(F.lit(1)) * 65536 + byte(F.lit(2)) * 256
        # a range of grams each: a single one of longer queries
        short = F.when(size == 1, F.struct(one.alias("lo"), (one + 65535).alias("hi"))).otherwise(F.struct(two.alias("lo"), (two + 255).alias("hi")))
        ranges = F.when(size > 2, F.transform(F.array_distinct(F.when(size > 2, whole)), lambda g: F.struct(g.alias("lo"), g.alias("hi")))).otherwise(F.array(short))
        asked = queries.where(size > 0).select("query_id", F.explode(ranges).alias("r")).select("query_id", "r.*").withColumn("bucket", F.shiftright("lo", 16))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # 256 at most
        asked = R._small(asked)
        counts = self._read("counts", buckets).join(asked.where("lo = hi").withColumnRenamed("lo", "gram"), ["bucket", "gram"])
        rarest = Window.partitionBy("query_id").orderBy("df", "gram")
        every = Window.partitionBy("query_id")
        named = asked.where("lo = hi").select("query_id", "bucket", F.col("lo").alias("gram")).join(counts.select("query_id", "gram", "df"), ["query_id", "gram"], "left")
        # a gram that no text has leaves its query without candidates
        ranked = named.withColumn("missing", F.max(F.col("df").isNull()).over(every)).where("not missing").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= RAREST)
        chosen = R._small(ranked.withColumn("need", F.count("*").over(every)).select("query_id", "bucket", "gram", "need"))
        posted = self._read("grams", buckets)
        hits = posted.join(chosen, ["bucket", "gram"]).select("query_id", "need", F.explode("chunks").alias("chunk_id"))
        hits = hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("query_id", "chunk_id")
        begun = asked.where("lo < hi").withColumnRenamed("bucket", "of")
        few = posted.join(begun, (F.col("bucket") == F.col("of")) & F.col("gram").between(F.col("lo"), F.col("hi"))).select("query_id", F.explode("chunks").alias("chunk_id")).distinct()
        return hits.unionByName(few)

    def search(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        """The first k chunks (chunk_id, ord, text), by position, that hold the whole query in either case; score 1."""
        asked = queries.select("query_id", F.lower("query").alias("q"))
        own = chunks.select("chunk_id", "ord", "text")
        found = own.join(R._small(self.candidates(asked)), "chunk_id").join(R._small(asked), "query_id").where(F.contains(F.lower("text"), F.col("q"))).select("query_id", "chunk_id", "ord")
        # an empty query is in every text: its hits are the first k
        first = own.where("text is not null").select("chunk_id", "ord").orderBy("ord", "chunk_id").limit(k)
        every = asked.where("q = ''").select("query_id").join(F.broadcast(first))
        w = Window.partitionBy("query_id").orderBy("ord", "chunk_id")
        return found.unionByName(every).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", F.lit(1.0).alias("score"))


def first_holding(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """As GramIndex.search, without an index: one pass over the texts, in slices, for a stated query set.

    A slice is one buffer of texts in order of position. A query is looked for in it up to the position of the k-th hit
    that the task has, so frequent queries end after a few texts; a task keeps k rows a query.
    """
    asked = [(r["query_id"], r["q"]) for r in queries.select("query_id", F.lower("query").alias("q")).where("query is not null").collect()]
    of: dict[bytes, list] = {}
    for i, q in asked:
        of.setdefault(q.encode(), []).append(i)
    kinds = [queries.schema["query_id"].dataType, *(chunks.schema[x].dataType for x in ("chunk_id", "ord"))]
    schema = Y.StructType([Y.StructField(x, t) for x, t in zip(("query_id", "chunk_id", "ord"), kinds, strict=True)])
    rank = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731 - nulls come first

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        best: dict[bytes, list] = {q: [] for q in of}
        for batch in slices(batches, 2):
            ids, ords, texts = (batch.column(x).to_pylist() for x in range(3))
            keys = [(rank(o), rank(i)) for o, i in zip(ords, ids, strict=True)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            keys = [keys[x] for x in order]
            own = [texts[x].encode() for x in order]
            data = b"\0".join([*own, b""])
            ends = np.cumsum([len(t) + 1 for t in own]).tolist()
            for q, held in best.items():
                at, row, last = 0, 0, len(own) if len(held) < k else bisect_left(keys, held[-1][0])
                while row < last and (p := data.find(q, at, ends[last - 1])) >= 0:
                    row = bisect_right(ends, p, row)
                    if p + len(q) >= ends[row]:  # it would run into the next text
                        at = p + 1
                        continue
                    insort(held, (keys[row], ids[order[row]], ords[order[row]]), key=lambda x: x[0])
                    del held[k:]
                    at, row = ends[row], row + 1
                    if len(held) == k:
                        last = bisect_left(keys, held[-1][0])
        found = [(i, chunk, o) for q, held in best.items() for _, chunk, o in held for i in of[q]]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(v), to_arrow_type(t)) for v, t in zip(columns, kinds, strict=True)], names=schema.names)

    texts = chunks.where("text is not null").select("chunk_id", "ord", F.lower("text").alias("text"))
    w = Window.partitionBy("query_id").orderBy("ord", "chunk_id")
    return texts.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", F.lit(1.0).alias("score"))


def slices(batches, column: int):
    """Slices of Arrow batches of about SLICE_BYTES of a text column; a longer text stands alone."""
    import pyarrow.compute as pc

    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), at + 1)
            yield batch.slice(at, end - at)
            at = end
