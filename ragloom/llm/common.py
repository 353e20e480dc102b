"""Shared pieces of the training-data operators: scratch tables, exact word hashing, components.

Word hashing works on the UTF-8 bytes of whole texts with numpy, so that a task never holds more
than a few megabytes of intermediate arrays whatever the length of its documents.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end words: ASCII space and \t \n \v \f \r.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Texts are hashed in pieces of about this many bytes.
PIECE_BYTES = 500_000
#: Batches are taken in slices of about this many bytes of text.
SLICE_BYTES = 4_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SCRATCH: list[tuple[SparkSession, str]] = []


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own in local mode (tests).

    A cluster without the setting is an error: its executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ragloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back.

    A lost executor then costs a re-read of shared files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Removes the files under a materialised table that nothing will read again."""
    spark = df.sparkSession
    roots = {p for _, p in _SCRATCH}
    for file in df.inputFiles():
        for root in [r for r in roots if r.rpartition("/")[2] in file]:
            _delete(spark, root)
            roots.discard(root)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] in roots]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing depends on this
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """The id as a long; of a row without one a key made of its text, above 2**62 and so after all usual ids.

    Rows without an id whose texts are equal have one key, like repeated rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(text, F.lit("no id")), 2).bitwiseOR(F.lit(1 << 62)))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit words."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base % (1 << 64), dtype=_U)
        grown[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(grown)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes, or of 64-bit hashes: span_hash() reads the hash of any span off them."""
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_BYTE_CODES[data] if data.dtype == np.uint8 else data) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal bytes wherever they stand."""
    raw = (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _byte_table(separators: Iterable[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words [^\x20\x09-\x0D]+, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and [^\x00-\x40\x5B-\x60\x7B-\x7F]+ (lower-cased text), as tables over bytes.
SPACED = _byte_table(SPACE_BYTES)
ALNUM = _byte_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LETTERS = _byte_table([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = kind[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def hash_words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, A-Z lower-cased, and each text's offset into them."""
    joined = b" ".join(texts).lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = word_spans(data, kind)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, at)


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t)
    if texts:
        yield first, len(texts)


def slices(batches, column: int = 0, limit: int = SLICE_BYTES) -> Iterator:
    """Slices of Arrow batches of about limit bytes in a column; a longer text stands alone.

    Memory that the task has freed goes back to the system when the batches end: an idle worker holds none.
    """
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum(np.cumsum(size) - 1, 0) // limit
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0, 0]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield batch.slice(lo, hi - lo)
    release()


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=_U).view(np.int64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of every endpoint of edges (a, b): the least id reachable.

    Alternating large-star and small-star rounds: no round makes more rows than it reads, and a star
    of any size is settled in one. Each round is a table in the shared folder.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    for _ in range(rounds):
        # large-star: each node's larger neighbours point at the least of its neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: each node's smaller neighbours, and itself, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new = materialise(small, "cc")
        # settled when every edge ends at a root and each node has one edge
        loose = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        twice = new.groupBy("a").count().where("count > 1")
        done = loose.isEmpty() and twice.isEmpty()
        drop_scratch(e) if e.inputFiles() else None
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
