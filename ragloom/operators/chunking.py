"""Chunking blocks into passages: recursive separators with overlap, chapters and deterministic ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATORS = ("\n\n", "。", "？", "！", "\n", "、", " ", "")


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 350
    most: int = 600
    overlap: int = 60
    least: int = 80


def _units(text: str, sep: str) -> list[str]:
    *whole, rest = text.split(sep)
    return [u + sep for u in whole] + ([rest] if rest else [])


def recursive_split(text: str, config: ChunkConfig = ChunkConfig(), level: int = 0) -> list[str]:
    """recursive_pieces() of one text in Python."""
    if len(text) <= config.most:
        return [text]
    if not SEPARATORS[level]:
        step = max(config.target - config.overlap, 1)
        return [text[i : i + config.target] for i in range(0, max(len(text) - config.target + step, 1), step)]
    pieces = [""]
    for unit in _units(text, SEPARATORS[level]):
        if pieces[-1] and len(pieces[-1]) + len(unit) > config.target:
            pieces.append(pieces[-1][-config.overlap :] if config.overlap else "")
        pieces[-1] += unit
    return [q for p in pieces for q in recursive_split(p, config, level + 1)]


#: Pieces that a fold appends to one array before it starts another: appending copies the array.
_PAGE = 512


def _filled(text: Column, separator: str, config: ChunkConfig) -> Column:
    """Pieces filled up to the target from units that end with a separator, each led by the end of the one before."""
    units = F.regexp_extract_all(text, F.lit(rf"(?s).*?\Q{separator}\E|.+\z"), F.lit(0))
    pages, page = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    begin = F.struct(pages.alias("pages"), page.alias("page"), F.lit("").alias("held"))

    def step(a: Column, unit: Column) -> Column:
        full = (a["held"] != "") & (F.length(a["held"]) + F.length(unit) > config.target)
        tail = F.substring(a["held"], -config.overlap, config.overlap) if config.overlap else F.lit("")
        turn = F.size(a["page"]) >= _PAGE
        done = F.struct(
            F.when(turn, F.array_append(a["pages"], a["page"])).otherwise(a["pages"]).alias("pages"),
            F.when(turn, F.array(a["held"])).otherwise(F.array_append(a["page"], a["held"])).alias("page"),
            F.concat(tail, unit).alias("held"),
        )
        return F.when(full, done).otherwise(F.struct(a["pages"].alias("pages"), a["page"].alias("page"), F.concat(a["held"], unit).alias("held")))

    return F.aggregate(units, begin, step, lambda a: F.concat(F.flatten(a["pages"]), a["page"], F.when(a["held"] != "", F.array(a["held"])).otherwise(page)))


def recursive_pieces(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """A text of up to `most` characters whole; a longer one filled up to the target from units of the coarsest
    separator, each piece with the end of the one before; pieces over `most` are split finer, level by level."""

    def finer(separator: str):
        def cut(piece: Column) -> Column:
            parts = _filled(piece, separator, config) if separator else T.windows(piece, config.target, config.overlap)
            return F.when(F.length(piece) <= config.most, F.array(piece)).otherwise(parts)

        return cut

    pieces = F.array(text)
    for separator in SEPARATORS:
        pieces = F.flatten(F.transform(pieces, finer(separator)))
    return pieces


def merge_short(pieces: DataFrame, least: int) -> DataFrame:
    """(source_id, ord, text, heading_path, page) of pieces (source_id, block_idx, part, text, heading_path, page).

    A piece under `least` characters goes to the chunk before it where that has the same heading path. All
    windows and groups are by source, so one shuffle serves them.
    """
    order = Window.partitionBy("source_id").orderBy("block_idx", "part")
    same = F.lag("part").over(order).isNotNull() & F.lag("heading_path").over(order).eqNullSafe(F.col("heading_path"))
    got = pieces.withColumn("first", F.when((F.length("text") < least) & same, 0).otherwise(1))
    got = got.withColumn("ord", (F.sum("first").over(order) - 1).cast("int"))
    one = got.groupBy("source_id", "ord").agg(F.array_sort(F.collect_list(F.struct("block_idx", "part", "text", "heading_path", "page"))).alias("x"))
    return one.select("source_id", "ord", F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text"), F.col("x")[0]["heading_path"].alias("heading_path"), F.col("x")[0]["page"].alias("page"))


def chunk_blocks(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(source_id, ord, chunk_id, text, heading_path, page) of blocks (source_id, block_idx, ...); pieces of low content drop out."""

    part = F.posexplode(recursive_pieces(F.coalesce("text", F.lit("")), config)).alias("part", "text")
    got = blocks.select(F.col("source_id").cast("string"), F.col("block_idx").cast("int"), "heading_path", F.col("page").cast("int"), part)
    got = merge_short(got.where(~T.is_low_content(F.col("text"))), config.least)
    return got.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source_id", F.col("ord").cast("string")), 256)).select("source_id", "ord", "chunk_id", "text", "heading_path", "page")


def chapters(lines: DataFrame) -> DataFrame:
    """Adds chapter to (source_id, line_no, line): the last chapter heading at or before each line."""
    mark = F.regexp_extract("line", r"^\s*((?:第[0-9０-９一二三四五六七八九十百]+章|(?i:chapter) \d+).{0,80})", 1)
    w = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("chapter", F.last(F.when(mark != "", F.trim(mark)), ignorenulls=True).over(w))
