"""File sources: kinds by suffix, text decoding and paragraphs, pages, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "markdown": "md|markdown", "text": "txt", "image": "png|jpg|jpeg|webp|tif|tiff|bmp", "audio": "wav|mp3|m4a|flac|ogg"}


def detect_kind(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(F.lower(path).rlike(rf"\.({suffixes})$"), F.lit(kind)).otherwise(out)
    return out


def fingerprint(files: DataFrame) -> Column:
    return F.concat_ws(":", F.col("length"), F.unix_micros("modificationTime"))


def read_files(spark: SparkSession, path: str, hidden: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder with kind and fingerprint; contents are read only where used.

    extensions: suffixes to take, in either case; all without. Hidden files and those in hidden folders below
    the root are left out; the root itself may be hidden. hidden keeps those that the file listing returns: Spark's
    own leaves out names that begin with . or _. Links are followed where the file system does.
    """
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    got = got.withColumn("kind", detect_kind(F.col("path"))).withColumn("fingerprint", fingerprint(got))
    if extensions:
        got = got.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    below = F.substring("path", F.instr("path", path.rstrip("/")) + len(path.rstrip("/")), F.length("path"))
    return got if hidden else got.where(~below.rlike(r"/\.[^/]"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.trim(b)), lambda b: b != "")


def pages(text: Column) -> Column:
    return F.split(text, "\f", -1)


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
