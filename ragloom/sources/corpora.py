"""JSON and XML sources: corpora, golden sets, thesauri, captions of laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.patterns import contained
from ..operators.retrieval import _small

CORPUS = "doc_id string, parent_id string, title string, caption string, text string"
GOLDEN = "name string, items array<struct<query string, relevant array<string>, tags array<string>>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.schema(CORPUS).option("multiLine", "true").json(path)
    return got.fillna("", ["title", "caption"])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, query_id, query, relevant, tags)."""
    got = spark.read.schema(GOLDEN).option("multiLine", "true").json(path)
    return got.select(F.col("name").alias("set_name"), F.posexplode("items").alias("query_id", "x")).select("set_name", "query_id", "x.*")


def corpus_chunks(corpus: DataFrame, captioned: bool = False) -> DataFrame:
    """Chunks of corpus rows: title, caption and text in one line, or (caption) above the text.

    Rows of one parent share a source, headed by their title; others are sources of their own, headed by their id.
    """
    plain = F.concat_ws(" ", "title", "caption", "text")
    text = F.when(F.col("caption") == "", F.col("text")).otherwise(F.concat(F.lit("("), F.col("caption"), F.lit(")\n"), F.col("text"))) if captioned else plain
    head = F.when(F.col("parent_id").isNotNull(), F.col("title")).otherwise(F.col("doc_id"))
    return corpus.select(F.col("doc_id").alias("chunk_id"), F.coalesce("parent_id", "doc_id").alias("source_id"), F.array(head).alias("heading_path"), text.alias("text"))


def thesaurus(json: Column) -> Column:
    """Array of (term, category, synonyms, scenarios, enrich_mode) of a JSON object; headers given as strings drop out."""
    kind = "struct<category:string,synonyms:array<string>,scenarios:array<string>,enrich_mode:string>"
    entries = F.filter(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.ltrim(e["value"]).startswith("{"))
    none = F.array().cast("array<string>")

    def row(e):
        v = F.from_json(e["value"], kind)
        return F.struct(e["key"].alias("term"), v["category"].alias("category"), F.coalesce(v["synonyms"], none).alias("synonyms"), F.coalesce(v["scenarios"], none).alias("scenarios"), F.coalesce(v["enrich_mode"], F.lit("both")).alias("enrich_mode"))

    return F.transform(entries, row)


def longest_entries(texts: DataFrame, entries: DataFrame, key: str, head: int, most: int) -> DataFrame:
    """Entries, beside key, whose term stands in the first `head` characters of text: the longest `most` of them."""
    hit = contained(texts, entries, key, head)
    w = Window.partitionBy(key).orderBy(F.desc(F.length("term")), "term")
    return hit.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).join(_small(entries), "term")


def thesaurus_terms(chunks: DataFrame, entries: DataFrame, head: int = 200, most: int = 3) -> DataFrame:
    """(chunk_id, terms): what the longest `most` entries found in a chunk's head add, by their mode."""
    none = F.array().cast("array<string>")
    own = F.concat(F.when(F.col("enrich_mode") == "scenario_only", none).otherwise(F.col("synonyms")), F.when(F.col("enrich_mode") == "literal_only", none).otherwise(F.col("scenarios")))
    best = longest_entries(chunks, entries, "chunk_id", head, most)
    return best.groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("terms"))


#: Characters of caption and text that entries are looked for in, and entries taken of a row: fixed values.
PROBE, PROBE_ENTRIES, FILLER = 300, 3, "—"


def sparse_text(text: Column, synonyms: Column, filler: str = FILLER) -> Column:
    """The text with each synonym replaced by a filler, in their order; runs of fillers and those beside a full stop shrink."""
    out = F.aggregate(F.filter(synonyms, lambda s: s != ""), text, lambda t, s: F.replace(t, s, F.lit(filler)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, f"{filler}{{2,}}", filler), f"{filler}。", "。"), f"。{filler}", "。")


def sparse_corpus(corpus: DataFrame, entries: DataFrame) -> DataFrame:
    """A corpus (doc_id, caption, text, ...) whose texts have lost the synonyms of the entries that they are about.

    Entries are those whose term is in the first PROBE characters of caption and text, the longest PROBE_ENTRIES, each
    with its synonyms from the longest; a synonym that is the caption stays. Texts without an entry shrink fillers alone.
    """
    probe = corpus.select("doc_id", F.concat("caption", "text").alias("text"))
    entry = F.struct((-F.length("term")).alias("length"), "term", "synonyms")
    found = longest_entries(probe, entries, "doc_id", PROBE, PROBE_ENTRIES).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    longest = lambda e: F.transform(F.array_sort(F.transform(e["synonyms"], lambda s, i: F.struct((-F.length(s)).alias("length"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    synonyms = F.coalesce(F.flatten(F.transform("entries", longest)), F.array().cast("array<string>"))
    own = F.filter(synonyms, lambda s: s != F.col("caption"))
    return corpus.join(found, "doc_id", "left").withColumn("text", sparse_text(F.col("text"), own)).drop("entries")


def law_articles(xml: Column, preview: int = 100) -> Column:
    """Array of (title, caption, preview) of the articles that have a caption."""
    inner = lambda x, tag: F.regexp_extract(x, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<Article(?:\s[^>]*)?>(.*?)</Article>"), F.lit(1))
    rows = F.transform(found, lambda x: F.struct(bare(inner(x, "ArticleTitle")).alias("title"), F.regexp_replace(bare(inner(x, "ArticleCaption")), r"^[(（]|[)）]$", "").alias("caption"), F.substring(bare(F.array_join(F.regexp_extract_all(x, F.lit(r"(?s)<Sentence(?:\s[^>]*)?>(.*?)</Sentence>"), F.lit(1)), "")), 1, preview).alias("preview")))
    return F.filter(rows, lambda r: r["caption"] != "")
