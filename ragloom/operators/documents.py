"""Chunking whole documents: by article where a document is made of articles, by chapter and block otherwise.

Headings are counted block by block first, so that only documents that can be made of articles are put
together in one row; all others stay spread over their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking as C

#: Segments that make a document one of articles, at least.
SEGMENTS = 3
LABEL, NEXT_LINE, SHORT_LABEL, HEAD_LINES = 80, 60, 6, 5
# How articles and chapters are headed.
JAPANESE = r"第[0-9０-９一二三四五六七八九十百千万〇零]{1,8}条(?:の[0-9０-９一二三四五六七八九十百千万]{1,4})?"
ENGLISH = r"(?:ARTICLE|Article)\s+(?:[IVXLCDM]+|[0-9]+)(?:\.[0-9]+)*|(?:SECTION|Section)\s+[0-9]+(?:\.[0-9]+)*|Sec\.\s*[0-9]+(?:\.[0-9]+)*|[0-9]+\.\s+[A-Z][a-zA-Z]"
CHAPTER = r"(?:第(?:[0-9]+|[一二三四五六七八九十百千万]+)章|[0-9]+章(?:[ 　\t]+[^0-9\n]|[ 　\t]*$)|Chapter[^\S\n]+[0-9]+)"

_TITLE = r"[ \t　]*(?:（[^（(\n]*）|\([^（(\n]*\))[\s　]*\n[\s　]*"
_NONE = "array<string>"


def heading(kind: str) -> str:
    """The pattern of a heading with its line start and the title in parentheses above it; group 1 is its label."""
    return rf"(?md)^(?:{_TITLE}|[\s　]*)({kind})"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def articles(text: Column, kind: str = JAPANESE) -> Column:
    """Array of (label, text, start) between headings; label is null in front of the first heading.

    start counts characters of text; segments are stripped and blank ones left out.
    """
    pattern = F.lit(heading(kind))
    labels = F.regexp_extract_all(text, pattern, F.lit(1))

    def whole(found: Column) -> Column:
        gaps = F.split(text, heading(kind), -1)
        return F.transform(gaps, lambda gap, i: F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), gap))

    def place(raw: Column) -> Column:
        starts = T.running(F.transform(raw, F.length))
        rows = F.arrays_zip(raw.alias("raw"), F.slice(starts, 1, F.size(raw)).alias("start"), F.concat(F.array(F.lit(None).cast("string")), labels).alias("label"))
        return F.transform(rows, lambda r: F.struct(F.substring(r["label"], 1, LABEL).alias("label"), strip(r["raw"]).alias("text"), r["start"].alias("start")))

    segments = T.let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: T.let(whole(found), place))
    return F.filter(segments, lambda s: s["text"] != "")


def chapter_label(text: Column) -> Column:
    """The chapter that a block begins: a heading among its first lines, with the next line where it is short."""
    lines = F.split(text, "\n")
    is_head = lambda line: line.rlike(rf"^[ \t　]*{CHAPTER}")

    def of(at: Column) -> Column:
        label = strip(F.substring(F.regexp_replace(F.get(lines, at), r"^[\s　]+", ""), 1, LABEL))
        after = F.get(F.filter(F.transform(F.slice(lines, at + 2, F.lit(3)), strip), lambda x: x != ""), 0)
        return F.when((F.length(label) <= SHORT_LABEL) & after.isNotNull(), F.concat(label, F.lit(" "), F.substring(after, 1, NEXT_LINE))).otherwise(label)

    numbers = F.transform(F.slice(lines, 1, HEAD_LINES), lambda line, i: F.when(is_head(line), i))
    return T.let(F.array_min(numbers), lambda at: F.when(at.isNotNull(), of(at)))


def split_at_chapters(blocks: DataFrame) -> DataFrame:
    """Blocks cut in front of each line that heads a chapter, numbered anew."""
    parts = F.filter(F.split("text", rf"(?md)\n(?=[ \t　]*{CHAPTER})"), lambda p: strip(p) != "")
    cut = blocks.select("source_id", "block_idx", "heading_path", "page", F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("source_id").orderBy("block_idx", "part")
    return cut.withColumn("block_idx", F.row_number().over(order) - 1).select("source_id", "block_idx", "text", "heading_path", "page")


def with_chapters(blocks: DataFrame) -> DataFrame:
    """Adds chapter: that of the block, or else of the last block before it that begins one."""
    upto = Window.partitionBy("source_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("chapter", F.last(chapter_label(F.col("text")), ignorenulls=True).over(upto))


def headed(chapter: Column, path: Column) -> Column:
    """The heading path with the chapter in front, unless it is there already."""
    own = F.coalesce(path, F.array().cast(_NONE))
    return F.when(chapter.isNull() | F.array_contains(own, chapter), own).otherwise(F.concat(F.array(chapter), own))


def article_segments(blocks: DataFrame) -> DataFrame:
    """(source_id, block_idx, text, heading_path, page): a row for each article of documents made of articles.

    An article has the page, heading and chapter of the block in which the white space ahead of it begins;
    where a block begins with the article, that is the block before.
    """
    n = lambda kind: F.sum(F.regexp_count("text", F.lit(heading(kind))))
    few = blocks.groupBy("source_id").agg(n(JAPANESE).alias("ja"), n(ENGLISH).alias("en")).where((F.col("ja") >= SEGMENTS - 1) | (F.col("en") >= SEGMENTS - 1))
    rows = with_chapters(blocks.join(few, "source_id", "left_semi"))
    one = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", "heading_path", "page", "chapter"))).alias("b"))
    texts = F.transform("b", lambda x: F.coalesce(x["text"], F.lit("")))
    one = one.withColumn("whole", F.array_join(texts, "\n\n")).withColumn("starts", T.running(F.transform(texts, lambda x: F.length(x) + 2)))
    enough = lambda kind: T.let(articles(F.col("whole"), kind), lambda a: F.when(F.size(a) >= SEGMENTS, a))
    cut = one.select("source_id", "b", "starts", F.posexplode(F.coalesce(enough(JAPANESE), enough(ENGLISH))).alias("block_idx", "a"))
    last = F.least(F.size(F.filter("starts", lambda s: s <= F.col("a.start"))), F.size("b"))
    cut = cut.withColumn("own", F.element_at("b", last))
    path = headed(F.col("own.chapter"), F.col("own.heading_path"))
    path = F.when(F.col("a.label").isNull(), path).otherwise(F.concat(path, F.array("a.label")))
    return cut.select("source_id", "block_idx", F.col("a.text").alias("text"), path.alias("heading_path"), "own.page")


def chunk_documents(blocks: DataFrame, config: C.ChunkConfig = C.ChunkConfig(), captions: bool = False) -> DataFrame:
    """(source_id, ord, chunk_id, text, heading_path, page, summary) of blocks (source_id, block_idx, text, heading_path, page).

    With a column kind, blocks of kind markdown keep their own headings. captions puts the last heading
    in front of each chunk.
    """
    own = blocks if "kind" in blocks.columns else blocks.withColumn("kind", F.lit(None).cast("string"))
    columns = ("source_id", "block_idx", "text", "heading_path", "page")
    free, marked = own.where("kind is distinct from 'markdown'").select(*columns), own.where("kind = 'markdown'").select(*columns)
    legal = article_segments(free)
    plain = with_chapters(split_at_chapters(free.join(legal.select("source_id").distinct(), "source_id", "left_anti")))
    plain = plain.withColumn("heading_path", headed(F.col("chapter"), F.col("heading_path"))).select(*columns)
    chunks = C.chunk_blocks(marked.unionByName(plain).unionByName(legal), config).withColumn("summary", T.chunk_summary(F.col("text")))
    return chunks.withColumn("text", T.inject_caption(F.col("heading_path"), F.col("text"))) if captions else chunks
