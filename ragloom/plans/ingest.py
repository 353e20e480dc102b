"""Ingest of files and of ready chunks into a store, and the state that makes it incremental.

Files are parsed in tasks, one bad file costs its own row; chunks are embedded in Arrow batches and written
as new versions, so a run that is repeated leaves the same rows.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import Full, Queue
from threading import Event, Thread

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bits as B
from ..operators import retrieval as R
from ..operators.store import ChunkStore
from ..sources import files as S
from ..sources import office
from . import parts

#: Pages that a task hands on at once.
ROWS_OUT = 256
STATE = "path string, source_id string, fingerprint string, version long"


@dataclass
class IndexCache:
    """Paths, their sources and fingerprints, as rows in a folder; the latest row of a path holds, one without fingerprint forgets it."""

    spark: SparkSession
    path: str

    def get(self, paths: DataFrame | None = None) -> DataFrame:
        """All that is held, or a part of it with all of the paths: rows of others are left out before they are shuffled."""
        try:
            rows = self.spark.read.schema(STATE).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows, paths = self.spark.createDataFrame([], STATE), None
        rows = rows if paths is None else B.maybe_in(rows, paths, ["path"], "near").where("near")
        latest = rows.groupBy("path").agg(F.max_by(F.struct("source_id", "fingerprint"), "version").alias("x"))
        return latest.select("path", "x.*").where("fingerprint is not null")

    def put(self, rows: DataFrame, version: int | None = None) -> None:
        rows = rows.select("path", "source_id", "fingerprint", F.lit(version or time.time_ns()).alias("version"))
        rows.hint("rebalance").write.mode("append").parquet(self.path)  # few files a write, as each is opened by every get()

    def forget(self, paths: DataFrame, version: int | None = None) -> None:
        none = F.lit(None).cast("string")
        self.put(paths.select("path").withColumns({"source_id": none, "fingerprint": none}), version)


@dataclass(frozen=True)
class Ingest:
    """store and embed are needed; without a cache every file counts as new. later: see ChunkStore.upsert."""

    store: ChunkStore
    embed: Callable[[Column], Column]
    chunker: Callable[[DataFrame], DataFrame] = parts.DocumentChunker()
    enrich: Callable[[DataFrame], DataFrame] | None = None
    cache: IndexCache | None = None
    later: bool = False

    def index_chunks(self, notebook: str, chunks: DataFrame, replace: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Embeds and stores chunks (chunk_id, source_id, ord, text, ...), in place of the sources in replace; their number."""
        own = self.enrich(chunks) if self.enrich else chunks
        own = own.withColumn("embedding", self.embed(T.embedding_text(F.col("heading_path"), F.col("text"))))
        gone = replace.select(F.lit(notebook).alias("notebook_id"), "source_id") if replace is not None else None
        return self.store.upsert(own.withColumn("notebook_id", F.lit(notebook)), replace=gone, batch=batch, notebook=notebook, later=self.later)

    def ingest(self, notebook: str, files: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Counts of files (path, kind, fingerprint, content): total, ingested, unchanged, skipped, failed, and chunks written.

        A file of unknown kind is skipped; one that cannot be read fails and is tried again next time. The
        chunks of a changed file take the place of those it had, in the same step. The state is written after the
        chunks: a run that died between the two stores the same chunks again. batch: see ChunkStore.upsert.
        """
        spark, version = files.sparkSession, time.time_ns()
        state = self.cache.get(files.select("path")) if self.cache else spark.createDataFrame([], STATE)
        known = R.ingest_plan(files.select("path", "kind", "fingerprint"), state.select("path", "fingerprint"))
        known = known.withColumns({"outcome": F.expr("if(kind is null, 'skipped', outcome)"), "source_id": F.sha2("path", 256)}).persist()
        # counted before anything is written: a write to the state's folder makes Spark read it again
        n = {r["outcome"]: r["n"] for r in known.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        # contents are shuffled by path only where many of them have not changed
        fresh = files.where("kind is not null")
        if n.get("unchanged"):
            fresh = fresh.join(R._small(known.where("outcome in ('new', 'changed')").select("path")), "path", "left_semi")
        parsed = office.parse_whole(fresh).persist()
        failed = parsed.where("error is not null").select("path").distinct()
        total, bad = sum(n.values()), failed.count()
        done = known.where("outcome in ('new', 'changed')")
        if bad:
            done = done.join(F.broadcast(failed) if bad <= R.BROADCAST_ROWS else failed, "path", "left_anti")
        sources = parsed.where("error is null").select(F.sha2("path", 256).alias("source_id"), "kind", "blocks")
        many = self.index_chunks(notebook, parts.chunk_sources(self.chunker, sources), done.where("outcome = 'changed'") if n.get("changed") else None, batch)
        if self.cache:
            self.cache.put(done, version)
        row = (total, n.get("new", 0) + n.get("changed", 0) - bad, n.get("unchanged", 0), n.get("skipped", 0), bad, many)
        parsed.unpersist()
        known.unpersist()
        return spark.createDataFrame([row], "total long, ingested long, unchanged long, skipped long, failed long, chunks long")

    def ingest_folder(self, notebook: str, path: str, extensions: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
        """ingest() of the files below a folder."""
        return self.ingest(notebook, S.read_files(self.store.spark, path, hidden, extensions))


PAGES = "source_id string, page int, text string, failed boolean"


def _pages_out(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names=["source_id", "page", "text", "failed"])


def overlapped(pages: Iterator[tuple], engine: Callable[[bytes], str], workers: int) -> Iterator[tuple]:
    """(source_id, page, text, failed) of pages (source_id, page, image, error), in order, read while others are recognised.

    A thread reads ahead into a queue of 2 * workers pages and waits when it is full; workers pages are with the
    engine at a time. So 3 * workers + 1 pages are held at most, however fast they are read. A page that fails, and
    one that comes with an error, is empty and marked.
    """
    waiting: Queue = Queue(2 * workers)
    stop, end = Event(), object()

    def read() -> None:
        last = end
        try:
            for page in pages:
                while not stop.is_set():
                    try:
                        waiting.put(page, timeout=0.1)
                        break
                    except Full:
                        continue
                if stop.is_set():
                    return
        except Exception as e:  # noqa: BLE001 - the reader's error is raised where the pages are taken
            last = e
        while not stop.is_set():
            try:
                return waiting.put(last, timeout=0.1)
            except Full:
                continue

    def recognise(source, page, image, error) -> tuple:
        if error is not None:
            return source, page, "", True
        try:
            return source, page, engine(image), False
        except Exception:  # noqa: BLE001 - one bad page must not end the job
            return source, page, "", True

    reader = Thread(target=read, daemon=True)
    reader.start()
    try:
        with ThreadPoolExecutor(workers) as pool:
            busy: deque = deque()
            while (page := waiting.get()) is not end:
                if isinstance(page, Exception):
                    raise page
                busy.append(pool.submit(recognise, *page))
                if len(busy) >= workers:
                    yield busy.popleft().result()
            while busy:
                yield busy.popleft().result()
    finally:
        stop.set()
        reader.join()


def recognise_files(files: DataFrame, pages_of: Callable[[], Callable[[bytes], Iterator[tuple[int, bytes]]]], engine: Callable[[], Callable[[bytes], str]], workers: int = 2) -> DataFrame:
    """(source_id, page, text, failed) of files (source_id, content): a rasteriser and an engine, made once a task, run side by side.

    A file whose rasteriser fails keeps the pages it gave and has one more row, with a null page, that is marked failed.
    """

    def run(batches):
        raster, own = pages_of(), engine()

        def pages():
            for batch in batches:
                for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        for page, image in raster(content):
                            yield source, page, image, None
                    except Exception as e:  # noqa: BLE001 - a damaged file costs its own row
                        yield source, None, b"", e

        out: list[tuple] = []
        for row in overlapped(pages(), own, workers):
            out.append(row)
            if len(out) >= ROWS_OUT:
                yield _pages_out(out)
                out = []
        yield _pages_out(out)

    return files.select(F.col("source_id").cast("string"), "content").mapInArrow(run, PAGES)


def recognise_pages(pages: DataFrame, engine: Callable[[], Callable[[bytes], str]], workers: int = 2) -> DataFrame:
    """(source_id, page, text) of page images (source_id, page, content); a page that fails is empty."""

    def run(batches):
        own = engine()
        rows = ((s, p, c, None) for batch in batches for s, p, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        yield _pages_out(list(overlapped(rows, own, workers)))

    return pages.select(F.col("source_id").cast("string"), F.col("page").cast("int"), "content").mapInArrow(run, PAGES).drop("failed")


def no_text() -> Callable[[bytes], str]:
    """A stub of an engine: every page is empty."""
    return lambda content: ""


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of recognised pages, blank ones left out."""
    order = Window.partitionBy("source_id").orderBy("page")
    rows = pages.where(F.trim("text") != "")
    return rows.select("source_id", (F.row_number().over(order) - 1).alias("block_idx"), "text", F.array(F.concat(F.lit("Page "), F.col("page").cast("string"))).alias("heading_path"), "page")
