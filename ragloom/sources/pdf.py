"""PDF text by extractors that the caller passes in, and recognised pages behind a cache in Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import pages, paragraphs

#: A recognised page: fingerprint names path, time and length of the file.
PAGES = "fingerprint string, page int, lines array<string>"


def text_layer(files: DataFrame, *extractors: Callable[[bytes], str]) -> DataFrame:
    """(path, block_idx, text, page) of files (path, content): paragraphs of pages that form feeds part.

    The first extractor that does not fail counts; a file that all fail on has no blocks.
    """

    def run(batches):
        import pyarrow as pa

        def text(content):
            for extract in extractors:
                try:
                    return extract(content)
                except Exception:  # noqa: BLE001 - the next extractor is the fallback
                    continue
            return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(c) for c in batch.column(1).to_pylist()], pa.string())], names=["path", "text"])

    got = files.select("path", "content").mapInArrow(run, "path string, text string")
    got = got.select("path", F.posexplode(pages(F.col("text"))).alias("page", "text"))
    blocks = F.transform(paragraphs(F.col("text")), lambda t: F.struct((F.col("page") + 1).alias("page"), t.alias("text")))
    every = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", blocks.alias("b")))).alias("x"))
    return every.select("path", F.posexplode(F.flatten(F.transform("x", lambda x: x["b"]))).alias("block_idx", "b")).select("path", "block_idx", "b.text", "b.page")


def cached_pages(images: DataFrame, cache: str, engine: Callable[[], Callable[[bytes], Iterable[str]]]) -> DataFrame:
    """PAGES of images (fingerprint, page, image): from the cache, and recognised where it has none.

    The cache is a folder of Parquet files that only grows; files that cannot be read count as misses. A
    page that fails has no row, so a later run tries it again. engine is made once a task.
    """
    spark = images.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    read = lambda: spark.read.schema(PAGES).option("ignoreCorruptFiles", "true").parquet(cache)
    missing = images.select("fingerprint", F.col("page").cast("int").alias("page"), "image")
    if there:
        missing = missing.join(read().select("fingerprint", "page"), ["fingerprint", "page"], "left_anti")

    def run(batches):
        import pyarrow as pa

        own = engine()
        for batch in batches:
            rows = []
            for name, page, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    rows.append((name, page, list(own(image))))
                except Exception:  # noqa: BLE001 - one bad page must not end the job; it stays a miss
                    continue
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names=["fingerprint", "page", "lines"])

    missing.mapInArrow(run, PAGES).write.mode("append").parquet(cache)
    wanted = images.select("fingerprint", F.col("page").cast("int").alias("page"))
    return read().dropDuplicates(["fingerprint", "page"]).join(wanted, ["fingerprint", "page"], "left_semi")
