"""Incremental ingest: a file stream whose batches go into a store, once each however often they are run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..plans.ingest import Ingest

#: Rows of a feed of files; modified orders the versions of a path.
FILES = "path string, kind string, fingerprint string, content binary, modified long"


def newest(files: DataFrame) -> DataFrame:
    """The newest row of each path, of equally new ones that of the greatest fingerprint; contents are shuffled only where paths repeat."""
    order = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("fingerprint"))
    h = F.xxhash64("path")
    repeated = files.groupBy(h.alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("repeats"))
    if repeated.isEmpty():
        return files
    rows = files.withColumn("h", h).join(R._small(repeated), "h", "left").drop("h")
    best = rows.where("repeats").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return rows.where("repeats is null").unionByName(best).drop("repeats")


def ingest_sink(ingest: Ingest, notebook: str, name: str) -> Callable[[DataFrame, int], None]:
    """A sink of batches of FILES: the newest row of each path is ingested into a notebook under the stream's name.

    What a batch replaces is left to the store's settle(), so a batch takes no longer the more the store holds.
    The store takes a batch once, and the state is written after the store: a batch that ran in part, or runs
    again, leaves what one run leaves. A batch before the last one of the store has its state too and is not read again.
    """

    ingest = replace(ingest, later=True)

    def sink(batch: DataFrame, number: int) -> None:
        if number >= ingest.store.snapshot()["batches"].get(name, -1):
            ingest.ingest(notebook, newest(batch).drop("modified"), (name, number))

    return sink


def ingest_stream(spark: SparkSession, path: str, ingest: Ingest, notebook: str, checkpoint: str, name: str, fmt: str = "parquet", files: int = 100):
    """Starts a stream over new files of a folder of FILES, `files` a batch; runs until all that is there is read."""
    rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").format(fmt).load(path)
    return rows.writeStream.queryName(name).foreachBatch(ingest_sink(ingest, notebook, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
