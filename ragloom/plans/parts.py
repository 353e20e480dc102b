"""Parts that the engine and the ingest plan take, with the implementations that need no model.

Chunkers take blocks and give chunks, enrichers take and give chunks; the others take and give Columns, so
that a batch of queries is one plan. A model plugs in as a function from prompts to replies.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import evaluation as E
from ..sources import corpora as J

Reply = Callable[[Column], Column]
CHUNK_COLUMNS = ("source_id", "ord", "chunk_id", "text", "heading_path", "page")


# ---------------------------------------------------------------- chunkers


def chunk_sources(chunker: Callable[[DataFrame], DataFrame], sources: DataFrame) -> DataFrame:
    """Chunks of (source_id, kind, blocks), a source with all its blocks a row: by the chunker's whole() where it has one."""
    if hasattr(chunker, "whole"):
        return chunker.whole(sources)
    return chunker(sources.select("source_id", "kind", F.explode("blocks").alias("b")).select("source_id", "kind", "b.*"))


@dataclass(frozen=True)
class WindowChunker:
    """Sliding windows of each block's characters, numbered within the source."""

    size: int = 350
    overlap: int = 60

    def __call__(self, blocks: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        cut = blocks.select("source_id", "block_idx", "heading_path", "page", F.posexplode(T.windows(F.col("text"), self.size, self.overlap)).alias("part", "text"))
        order = Window.partitionBy("source_id").orderBy("block_idx", "part")
        return self._named(cut.withColumn("ord", (F.row_number().over(order) - 1).cast("int")))

    def whole(self, sources: DataFrame) -> DataFrame:
        """The same of rows (source_id, blocks), numbered within the row: no text is shuffled or sorted."""
        cut = lambda b: F.transform(T.windows(b["text"], self.size, self.overlap), lambda w: F.struct(w.alias("text"), b["heading_path"].alias("heading_path"), b["page"].alias("page")))
        parts = F.flatten(F.transform(F.filter("blocks", lambda b: b["text"].isNotNull()), cut))
        return self._named(sources.select("source_id", F.posexplode(parts).alias("ord", "x")).select("source_id", "ord", "x.*"))

    def _named(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source_id", F.col("ord").cast("string")), 256)).select(*CHUNK_COLUMNS)


@dataclass(frozen=True)
class DocumentChunker:
    """Articles, chapters and recursive splits."""

    config: C.ChunkConfig = C.ChunkConfig()
    captions: bool = False

    def __call__(self, blocks: DataFrame) -> DataFrame:
        return D.chunk_documents(blocks, self.config, self.captions).select(*CHUNK_COLUMNS)


@dataclass(frozen=True)
class DispatchChunker:
    """A chunker for each kind of source, another for the rest. blocks have a column kind."""

    by_kind: dict[str, Callable[[DataFrame], DataFrame]]
    rest: Callable[[DataFrame], DataFrame] = DocumentChunker()

    def __call__(self, blocks: DataFrame) -> DataFrame:
        known = list(self.by_kind)
        out = self.rest(blocks.where(F.col("kind").isNull() | ~F.col("kind").isin(known)))
        for kind, chunker in self.by_kind.items():
            out = out.unionByName(chunker(blocks.where(F.col("kind") == kind)))
        return out

    def whole(self, sources: DataFrame) -> DataFrame:
        known = list(self.by_kind)
        out = chunk_sources(self.rest, sources.where(F.col("kind").isNull() | ~F.col("kind").isin(known)))
        for kind, chunker in self.by_kind.items():
            out = out.unionByName(chunk_sources(chunker, sources.where(F.col("kind") == kind)))
        return out


# ---------------------------------------------------------------- enrichers


def heading_captions(chunks: DataFrame) -> DataFrame:
    """The last heading in parentheses above each text."""
    return chunks.withColumn("text", T.inject_caption(F.col("heading_path"), F.col("text")))


@dataclass(frozen=True)
class ThesaurusEnricher:
    """Adds what the longest terms of a thesaurus in a chunk's head stand for."""

    entries: DataFrame

    def __call__(self, chunks: DataFrame) -> DataFrame:
        found = J.thesaurus_terms(chunks, self.entries)
        none = F.array().cast("array<string>")
        return chunks.join(found, "chunk_id", "left").withColumn("text", P.enrich(F.col("text"), F.coalesce("terms", none))).drop("terms")


@dataclass(frozen=True)
class QuestionEnricher:
    """Adds the questions that a model says a chunk answers, at most `most` of them."""

    reply: Reply
    most: int = 5

    def __call__(self, chunks: DataFrame) -> DataFrame:
        asked = P.questions_prompt(F.col("text"), self.most)
        return chunks.withColumn("text", P.enrich(F.col("text"), F.slice(P.parse_numbered_list(self.reply(asked)), 1, self.most)))


# ---------------------------------------------------------------- queries


def passthrough(query: Column) -> Column:
    """A rewriter without variants."""
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class ListRewriter:
    """Variants from a model's numbered list."""

    reply: Reply
    most: int = 4

    def __call__(self, query: Column) -> Column:
        return F.slice(P.parse_numbered_list(self.reply(P.rewrite_prompt(query, self.most))), 1, self.most)


@dataclass(frozen=True)
class ExpandRewriter:
    """Paraphrases, subquestions and a made-up passage from one reply."""

    reply: Reply

    def __call__(self, query: Column) -> Column:
        return P.parse_expand(self.reply(P.expand_prompt(query)))


class FifoCache:
    """A bounded map on the driver; the entry that came first goes first."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, OrderedDict()

    def get(self, key):
        return self.held.get(key)

    def put(self, key, value) -> None:
        if key not in self.held and len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = value


@dataclass
class IntentClassifier:
    """Intents of queries: by plain rules, else by a model's reply, else lookup; replies are kept for their query."""

    reply: Reply | None = None
    cache: FifoCache = field(default_factory=FifoCache)

    def column(self, query: Column) -> Column:
        summary = F.when(P.is_summary_query(query), "summary")
        told = P.parse_intent(self.reply(P.intent_prompt(query)))["kind"] if self.reply else F.lit("lookup")
        return F.coalesce(P.fast_intent(query), summary, told)

    def one(self, spark, query: str) -> str:
        if (held := self.cache.get(query)) is None:
            held = spark.createDataFrame([(query,)], "q string").select(self.column(F.col("q"))).first()[0]
            self.cache.put(query, held)
        return held


# ---------------------------------------------------------------- contexts and answers


@dataclass(frozen=True)
class OverlapCompressor:
    """Keeps the sentences of a text that share most bigrams with the query, in their order."""

    least: float = 0.20
    keep: int = 3
    ratio: float = 0.3

    def __call__(self, query: Column, text: Column) -> Column:
        q = T.bigrams(query)
        scored = F.transform(T.compressor_sentences(text), lambda s: F.struct(s.alias("text"), F.round(T.containment(q, T.bigrams(s)), 9).alias("score")))
        return T.let(scored, lambda x: P.compress(x, self.least, self.keep, self.ratio))


def echo(prompt: Column) -> Column:
    """A stub of a generator: the last line of its prompt."""
    return F.concat(F.lit("[stub] "), F.element_at(F.split(prompt, "\n"), -1))


def overlap_judge(query: Column, context: Column, answer: Column) -> Column:
    return E.faithfulness(answer, context)


@dataclass(frozen=True)
class ReplyJudge:
    """The first number between 0 and 1 of a model's reply."""

    reply: Reply

    def __call__(self, query: Column, context: Column, answer: Column) -> Column:
        return T.first_unit_float(self.reply(P.judge_prompt(query, context, answer)))
