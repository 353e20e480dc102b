"""Queries over ingest, the store, the engine and the parts around models, with their SQL.

Inputs that the tables lack (article numbers, replies of models, markers) are made from whole columns by
expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embed as M
from .functions import media as A
from .functions import prompts as P
from .functions import text as T
from .operators import evaluation as E
from .operators import retrieval as R
from .operators import signals as G
from .operators import store as D
from .plans import parts
from .plans.ask import Engine, SearchOptions
from .plans.ingest import IndexCache, Ingest
from .sources import corpora as J
from .sources import files as S
from .sources.scratch import shared_folder


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("ord"), F.array("lang", "source").alias("heading_path"), "lang", "text")


def _queries(s, d):
    return _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _legal():
    """The text with a legal head, of chunks."""
    return F.expr(LEGAL.replace("doc_id", "chunk_id").replace("source", "source_id"))


# ---------------------------------------------------------------- ingest and store

#: What a file of each document is called; a few have no parser, a few are damaged.
PATH = "'d/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 50 = 7 THEN '.xyz' WHEN doc_id % 50 = 9 THEN '.docx' ELSE '.txt' END"


def _ingested(s, d):
    """A store after two runs: the first saw older texts of each third document."""
    store = D.ChunkStore(s, shared_folder(s, "store"))
    ingest = Ingest(store, lambda t: M.bigram_embedding(t, 64), parts.WindowChunker(350, 60), cache=IndexCache(s, shared_folder(s, "state")))
    docs = _t(s, d, "documents").select(F.expr(PATH).alias("path"), "doc_id", "text")
    files = lambda x: x.withColumns({"kind": S.detect_kind(F.col("path")), "fingerprint": F.md5("text"), "content": F.col("text").cast("binary")})
    ingest.ingest("all", files(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text")))))
    report = ingest.ingest("all", files(docs))
    return store, report


def q_ingest_store(s, d):
    store, _ = _ingested(s, d)
    return store.chunks("all").select("source_id", "ord", F.md5("text").alias("digest"), F.size("embedding").alias("dims"))


def q_ingest_report(s, d):
    return _ingested(s, d)[1]


def q_store_search(s, d):
    """The store's vector and keyword search, neighbours and representatives."""
    store = D.ChunkStore(s, shared_folder(s, "store"))
    key = lambda c: F.lpad(c.cast("string"), 12, "0")
    v = _t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = _t(s, d, "documents").join(v, "doc_id", "left").select(key(F.col("doc_id")).alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("ord"), "text", F.array("lang").alias("heading_path"), "embedding", F.lit("all").alias("notebook_id"))
    store.upsert(rows)
    out = lambda df, kind, a="query_id": df.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), F.col("chunk_id").alias("b"), "rank")
    e = _t(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    hits = store.search_vectors(e, 10, "all")
    got = out(hits, "vector").unionByName(out(store.search_keywords(_queries(s, d), 10, "all"), "keyword"))
    near = store.neighbours(hits.where("rank = 1").select("chunk_id"), 30, "all").select(F.col("hit_id").alias("query_id"), F.col("near_id").alias("chunk_id"), F.lit(0).alias("rank"))
    first = store.representatives(3, "all").select(F.col("source_id").alias("query_id"), "chunk_id", F.lit(0).alias("rank"))
    return got.unionByName(out(near, "neighbour")).unionByName(out(first, "representative"))


def q_indexes(s, d):
    """All captions, headings and defined terms."""
    c = _docs(s, d).withColumn("text", _legal())
    part = lambda kind: D.index_of(c, kind).select(F.lit(kind).alias("kind"), "chunk_id", "caption")
    return part("captions").unionByName(part("headings")).unionByName(part("defined_terms"))


def q_sources(s, d):
    """Counts of chunks by source, the largest source, sources of an exact size, and texts like a pattern."""
    c = _docs(s, d)
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), "source_id", "n")
    like = D.source_counts(D.text_like(c, "%the%"))
    return part("all", D.source_counts(c)).unionByName(part("largest", D.largest_source(c))).unionByName(part("single", D.source_counts(c, 7))).unionByName(part("like", like))


def q_caption_samples(s, d):
    return D.caption_samples(_docs(s, d).withColumn("text", _legal()), 20)


def q_topic(s, d):
    c = _docs(s, d)
    return D.representatives_for_topic(c.drop("lang"), F.lit("fr"), 2).select("source_id", "chunk_id")


def q_hit_documents(s, d):
    e = _t(s, d, "embeddings")
    hits = R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 10)
    return D.documents_of(hits.select("query_id", "chunk_id", "rank"), _docs(s, d))


# ---------------------------------------------------------------- engine


def q_search(s, d):
    """The engine's search: noise out of both rankings before ranks count, fusion, words, one hit a source."""
    v = _t(s, d, "embeddings")
    q = _queries(s, d).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    engine = Engine(_docs(s, d), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))
    return engine.search(q, SearchOptions(k=10, per_source=2))


def q_sweep(s, d):
    """Mean metrics of three runs that keep the first 3, 5 and 10 vector hits."""
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    golden = q, e.select(F.col("vec_id").alias("relevant_id"), "label")
    hits = R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 10)
    runs = hits.select(F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("run_id"), "query_id", "chunk_id", "rank").where("rank <= run_id")
    return E.weight_sweep(runs, golden, 5)


def q_summary(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    golden = q, e.select(F.col("vec_id").alias("relevant_id"), "label")
    hits = R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 10)
    return E.summarise(E.metrics(hits, golden, 5))


def q_golden_kind(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("parent_id"))
    by = lambda kind, ids: G.golden_granularity(ids, docs).select(F.lit(kind).alias("kind"), "granularity")
    return by("docs", _t(s, d, "labels").select(F.col("doc_id").cast("string").alias("relevant_id"))).unionByName(by("parents", docs.select(F.col("parent_id").alias("relevant_id")))).unionByName(by("others", _t(s, d, "pages").select(F.col("url").alias("relevant_id"))))


def q_signals(s, d):
    """Share of specific queries, novelty of bodies against captions, mean length of captions."""
    c = _docs(s, d).withColumn("text", _legal())
    q = _queries(s, d).withColumn("query", F.expr(ASKED.replace("item_id", "query_id").replace("text", "query")))
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("value"))
    return one(G.specific_ratio(q), "specific").unionByName(one(G.caption_length(c), "caption_length")).unionByName(one(G.paraphrase_score(c), "novelty"))


def q_title_match(s, d):
    q = _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = _t(s, d, "pages").select(F.col("page_id").alias("chunk_id"), F.col("page_id").alias("ord"), S.headings(F.col("html")).alias("heading_path"))
    return G.title_match(q, c).select("query_id", F.round("recall", 9).alias("recall"))


# ---------------------------------------------------------------- text around models

LEGAL = "CASE doc_id % 4 WHEN 0 THEN '第' || CAST(doc_id % 90 + 1 AS STRING) || '条 ' || text WHEN 1 THEN '(条例第3号改正)\n第3条の2 ' || text WHEN 2 THEN '(' || source || ')\n「用語' || lang || '」とは、次をいう。「' || lang || '」という。' || text ELSE text END"
ASKED = "CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN 'article 12 of it' WHEN 2 THEN 'say \"' || substring(text, 1, 8) || '\"' WHEN 3 THEN substring(text, 1, 6) WHEN 4 THEN 'see https://a.b/c' ELSE substring(text, 1, 30) END"
REPLY = "CASE item_id % 4 WHEN 0 THEN 'INTENT: Compare\nTOPIC: ' || replace(substring(text, 1, 12), '\n', ' ') || '\nSOURCES: a, b ,,c' WHEN 1 THEN 'intent: summary\ntopic: all' WHEN 2 THEN 'INTENT: dance\nINTENT: lookup\nSOURCES: ' ELSE text END"
LISTED = "'Here:\n1. ' || replace(substring(text, 1, 20), '\n', ' ') || '\n2) \"' || replace(substring(text, 5, 20), '\n', ' ') || '\"\n- ' || replace(substring(text, 9, 15), '\n', ' ') || '\nso'"
JOINED = "CASE item_id % 3 WHEN 0 THEN 'not found' WHEN 1 THEN 'I don''t know.' ELSE 'It was not found ' || text END"


def q_leads(s, d):
    """Leads of articles, captions, defined terms and revision notes of texts with such heads."""
    t = F.expr(LEGAL)
    return _t(s, d, "documents").select("doc_id", T.article_lead(t).alias("lead"), F.array_join(T.defined_terms(t), "|").alias("terms"), T.is_revision_note(F.substring(t, 1, 12)).alias("revision"), T.caption_or_lead(t).alias("caption"))


def q_specific(s, d):
    q = F.expr(ASKED)
    return _t(s, d, "benchmark").select("item_id", T.is_specific_query(q).alias("specific"), P.fast_intent(q).alias("intent"))


def q_replies(s, d):
    """What is read out of models' replies: intents, lists, numbers, refusals, variants."""
    parsed, listed = P.parse_intent(F.expr(REPLY)), P.parse_numbered_list(F.expr(LISTED))
    return _t(s, d, "benchmark").select("item_id", parsed["kind"].alias("kind"), parsed["topic"].alias("topic"), F.array_join(parsed["sources"], "|").alias("sources"), F.array_join(listed, "|").alias("items"), T.first_unit_float(F.expr("'score .' || CAST(item_id % 10 AS STRING) || ' or 7'")).alias("number"), P.looks_like_refusal(F.expr(JOINED)).alias("refusal"), F.size(P.query_variants(F.substring("text", 1, 20), F.concat(listed, listed), 2)).cast("long").alias("n_variants"))


def q_expand(s, d):
    reply = F.expr("'PARAPHRASE: ' || substring(text, 1, 30) || '\nPARAPHRASE : x\nSUBQUESTION: 1. ' || substring(text, 2, 20) || '\nHYDE: ' || text")
    return _t(s, d, "benchmark").select("item_id", F.array_join(P.parse_expand(reply), "|").alias("variants"))


def q_context(s, d):
    """Context blocks of vector hits."""
    e = _t(s, d, "embeddings")
    hits = R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 5)
    return P.context_block(hits.join(_docs(s, d).select("chunk_id", "text"), "chunk_id")).select("query_id", F.md5("context").alias("digest"))


def q_truncate(s, d):
    kept = P.middle_truncate(F.split("text", " "), 464, 200, 40, 100)
    return _t(s, d, "documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.md5(F.array_join(kept, " ")).alias("digest"))


def q_must(s, d):
    items = F.array(F.array(F.lit("the"), F.lit("de")), F.array(F.lit("a")))
    return _t(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", P.must_include(F.col("text"), items).alias("ok"))


def q_spans(s, d):
    """Sentences with byte offsets."""
    x = _t(s, d, "documents").select("doc_id", F.explode(T.sentence_spans(F.col("text"))).alias("x"))
    return x.select("doc_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.md5("x.text").alias("digest"))


def q_fts(s, d):
    tokens = T.bigram_tokens(F.concat(F.lit("日本語の本 と木 "), "text"))
    return _t(s, d, "documents").select("doc_id", F.md5(P.tokenize_for_fts(tokens)).alias("digest"))


def q_compressed(s, d):
    """Compressor sentences and those kept for a query, the title of the source."""
    text = F.regexp_replace("text", r"\. ", "! ")
    return _t(s, d, "documents").select("doc_id", F.size(T.compressor_sentences(text)).cast("long").alias("n"), F.md5(F.array_join(T.compressor_sentences(text), "|")).alias("digest"))


def q_overlap(s, d):
    """Sorted tokens by which an answer is held against a source."""
    return _t(s, d, "conversations").select("conv_id", "turn", F.array_join(T.overlap_tokens(F.col("text")), " ").alias("tokens"))


def q_citation_spans(s, d):
    """Answers that cite the turn before them, and the sentence there that is nearest."""
    c = _t(s, d, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id")
    answers = c.where("role = 'assistant'").select(key, F.concat("text", F.lit(" [1] and [2].")).alias("answer"))
    hits = c.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("query_id"), F.lit(1).alias("rank"), "text")
    return E.verify_citations(answers, hits).select("query_id", "total", "unsupported", F.round("ratio", 9).alias("ratio"))


# ---------------------------------------------------------------- files and media


def q_paragraphs(s, d):
    """Blocks between blank lines, pages between form feeds."""
    t = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    blocks = _t(s, d, "documents").select("doc_id", F.posexplode(S.paragraphs(t)).alias("n", "block"))
    pages = _t(s, d, "documents").select("doc_id", F.size(S.pages(F.replace("text", F.lit(". "), F.lit("\f")))).cast("long").alias("n_pages"))
    return blocks.join(pages, "doc_id").select("doc_id", F.col("n").cast("long").alias("n"), F.md5("block").alias("digest"), "n_pages")


def q_segments(s, d):
    """Transcripts as blocks under the file's name, blank segments left out."""
    t = _t(s, d, "conversations").select(F.concat(F.lit("a/b/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".wav")).alias("path"), F.array("text", F.lit("  "), "role").alias("segments"))
    return A.segments_as_blocks(t).select("path", F.col("block_idx").cast("long").alias("block_idx"), F.md5("text").alias("digest"), F.array_join("heading_path", "/").alias("heading")).join(t.select("path", F.md5(A.transcript_body(F.col("segments"))).alias("body")), "path")


def q_lines(s, d):
    """Lines of a page: those inside it and confident, top to bottom, joined into a paragraph."""
    words = F.split("text", " ")
    boxes = F.transform(words, lambda w, i: F.struct(F.when(i % 7 == 3, F.lit("block")).otherwise("line_main").alias("kind"), F.lit(0).alias("x0"), (F.size(words) - i).alias("y0"), F.lit(9).alias("x1"), (F.size(words) - i + 1).alias("y1"), F.when(i % 5 == 0, 0.2).otherwise(0.9).alias("confidence"), w.alias("text")))
    lines = A.page_lines(boxes, 0.5)
    return _t(s, d, "benchmark").select("item_id", F.array_join(lines, " ").alias("lines"), F.md5(A.join_lines(F.concat(F.array(F.lit("日本"), F.lit("語")), lines))).alias("digest"))


def q_sparse(s, d):
    none = F.array(F.lit("the"), F.col("lang"))
    return _t(s, d, "documents").select("doc_id", F.md5(J.sparse_text(F.col("text"), none)).alias("digest"))


def q_corpus_chunks(s, d):
    corpus = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("parent_id"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("caption"), "text")
    return J.corpus_chunks(corpus, True).select("chunk_id", "source_id", F.array_join("heading_path", "/").alias("heading"), F.md5("text").alias("digest"))


def q_answer_sources(s, d):
    """What questions of each intent are answered from: summaries, comparisons, small talk, lookups."""
    v = _t(s, d, "embeddings")
    q = _queries(s, d).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    engine = Engine(_docs(s, d), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("lookup", "compare", "summary", "smalltalk")]), (F.col("query_id") % 4 + 1).cast("int"))
    return engine.sources_of(q.withColumn("intent", kinds), SearchOptions(k=10, drop_noise=False)).select("query_id", "rank", "chunk_id", F.md5("text").alias("digest"))


def q_text_hashes(s, d):
    """Hash embeddings of texts, checked by the hash's own arithmetic."""
    v = _t(s, d, "benchmark").select("item_id", M.hash_embedding(F.col("text"), 12).alias("v"))
    return v.select("item_id", F.posexplode("v").alias("dim", "x")).select("item_id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def q_compress(s, d):
    """Texts cut to the sentences that share most with a query, and a floor of the best."""
    text, query = F.regexp_replace("text", r"\. ", "! "), F.substring("text", 5, 30)
    return _t(s, d, "benchmark").select("item_id", F.md5(parts.OverlapCompressor()(query, text)).alias("digest"))


def q_source_texts(s, d):
    return D.texts_by_source(_docs(s, d)).select("source_id", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "\n")).alias("digest"))


def q_nearest(s, d):
    """Per cited turn the sentence that is nearest to the citing one."""
    c = _t(s, d, "conversations")
    answers = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.regexp_replace("text", r"[.!?\s]+$", ""), F.lit(" [1].")).alias("answer"))
    hits = c.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("query_id"), F.lit(1).alias("rank"), "text")
    return E.citation_spans(answers, hits).select("query_id", "rank", F.md5("said").alias("said"), F.md5("sentence").alias("sentence"), "overlap")


QUERIES = {
    "ingest_store": q_ingest_store, "ingest_counts": q_ingest_report, "store_search": q_store_search, "store_indexes": q_indexes, "source_counts": q_sources, "caption_samples": q_caption_samples, "topic_representatives": q_topic, "hit_documents": q_hit_documents,
    "engine_search": q_search, "answer_sources": q_answer_sources, "text_hashes": q_text_hashes, "weight_sweep": q_sweep, "metrics_summary": q_summary, "golden_granularity": q_golden_kind, "corpus_signals": q_signals, "title_match": q_title_match,
    "article_leads": q_leads, "specific_queries": q_specific, "model_replies": q_replies, "expanded_queries": q_expand, "context_blocks": q_context, "middle_truncate": q_truncate, "must_include": q_must, "sentence_spans": q_spans, "fts_tokens": q_fts, "compressor_sentences": q_compressed, "overlap_tokens": q_overlap, "citation_check": q_citation_spans,
    "paragraph_blocks": q_paragraphs, "transcript_blocks": q_segments, "page_lines": q_lines, "sparse_text": q_sparse, "corpus_chunks": q_corpus_chunks, "compressed_texts": q_compress, "texts_by_source": q_source_texts, "citation_spans": q_nearest,
}


def _duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def oracle(vec: str, bm: str, bi: str) -> dict[str, str]:
    """vec, bm: common tables of vector and keyword rankings; bi: the bigrams of a text."""
    windows = "SELECT doc_id, unnest(range(0, 1 + CAST(greatest(ceil((length(t) - 350) / 290.0), 0) AS BIGINT))) i, t FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t FROM documents WHERE doc_id % 50 NOT IN (7, 9)) WHERE length(t) > 0"
    legal, asked, listed = _duck(LEGAL), _duck(ASKED), _duck(LISTED)
    code = "regexp_matches({0}, '[A-Z_]{{4}}') OR length(regexp_replace({0}, '[^(){{}};=%<>]', '', 'g')) >= 2 OR len(list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: contains(w, '_') AND length(w) >= 4)) > 0 OR len(list_filter(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: length(w) >= 5 AND regexp_matches(w, '^[A-Z][A-Za-z]+[A-Z]'))) > 0".format("q")
    specific = "(regexp_matches(q, '第[0-9０-９一二三四五六七八九十百]+条|(?i:article [0-9])') OR regexp_matches(q, '\"[^\"]{2,}\"|「[^」]{2,}」') OR regexp_matches(q, 'https?://|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_]') OR " + code + " OR length(q) >= 50)"
    note = "regexp_extract(t, '^[(]([^)]*)[)]', 1)"
    body = "CASE WHEN contains(" + note + ", '条例') AND regexp_matches(" + note + ", '改正|全改|追加|削除|旧') THEN regexp_replace(t, '^[(][^)]*[)]\\s*', '') ELSE t END"
    lead = "nullif(regexp_replace(regexp_extract(" + body + ", '^第[0-9一二三四五六七八九十百千〇零]+条(?:の[0-9一二三四五六七八九十]+)?[\\s　]*([^。\\n]{1,80})', 1), '\\s+$', ''), '')"
    caption = "CASE WHEN doc_id % 4 = 2 THEN nullif(source, '') END"
    terms = "CASE WHEN doc_id % 4 = 2 THEN lang ELSE '' END"
    gold = ", g AS (SELECT DISTINCT a.vec_id query_id, b.vec_id chunk_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0), n AS (SELECT query_id, count(*) n FROM g GROUP BY 1)"

    def mean(runs: str, key: str = "") -> str:
        return gold + f""", rr AS ({runs}), ks AS (SELECT DISTINCT run_id FROM rr), f AS (SELECT run_id, query_id, sum(CASE WHEN "rank" <= 5 THEN 1 ELSE 0 END) m, sum(CASE WHEN "rank" <= 5 THEN 1 / log2("rank" + 1) ELSE 0 END) dcg, min("rank") best FROM rr JOIN g USING (query_id, chunk_id) GROUP BY 1, 2),
 p AS (SELECT run_id, coalesce(CAST(m AS DOUBLE) / n, 0) recall, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END hit, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 9) ndcg, coalesce(1.0::DOUBLE / best, 0) rr FROM ks CROSS JOIN n LEFT JOIN f USING (run_id, query_id))
 SELECT {key or 'count(*) queries,'} round(avg(recall), 6) recall, round(avg(hit), 6) hit, round(avg(ndcg), 6) ndcg, round(avg(rr), 6) rr FROM p{' GROUP BY run_id' if key else ''}"""

    noise = "(trim(text) = '' OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 25 OR (length(trim(text)) < 60 AND length(regexp_replace(trim(text), '[^.・…─━·]', '', 'g')) * 10 >= length(trim(text)) * 3) OR len(list_filter(string_split(trim(text), chr(10)), lambda x: regexp_matches(trim(x), '^[0-9][^.]{0,6}[.]'))) >= 2)"
    return {
        "ingest_store": f"SELECT sha256('d/' || doc_id || '.txt') source_id, CAST(i AS INT) ord, md5(substring(t, i * 290 + 1, 350)) digest, CAST(64 AS INT) dims FROM ({windows})",
        "ingest_counts": f"SELECT count(*) total, count(*) FILTER (WHERE doc_id % 50 NOT IN (7, 9) AND doc_id % 3 = 0) ingested, count(*) FILTER (WHERE doc_id % 50 NOT IN (7, 9) AND doc_id % 3 <> 0) unchanged, count(*) FILTER (WHERE doc_id % 50 = 7) skipped, count(*) FILTER (WHERE doc_id % 50 = 9) failed, (SELECT count(*) FROM ({windows}) WHERE doc_id % 3 = 0) chunks FROM documents",
        "store_search": vec.replace("FROM q, embeddings)", "FROM q, embeddings WHERE vec_id IN (SELECT doc_id FROM documents))") + ", " + bm.removeprefix("WITH ").replace(" r AS (", " kr AS (") + """, top AS (SELECT * FROM v WHERE "rank" = 1)
 SELECT 'vector' kind, CAST(query_id AS VARCHAR) a, lpad(CAST(chunk_id AS VARCHAR), 12, '0') b, "rank" FROM v
 UNION ALL SELECT 'keyword', CAST(query_id AS VARCHAR), lpad(CAST(chunk_id AS VARCHAR), 12, '0'), "rank" FROM kr WHERE "rank" <= 10
 UNION ALL SELECT 'neighbour', lpad(CAST(x.doc_id AS VARCHAR), 12, '0'), lpad(CAST(y.doc_id AS VARCHAR), 12, '0'), 0 FROM documents x JOIN documents y ON x.source = y.source AND y.doc_id BETWEEN x.doc_id - 30 AND x.doc_id + 30 WHERE x.doc_id IN (SELECT chunk_id FROM top)
 UNION ALL SELECT 'representative', source, lpad(CAST(doc_id AS VARCHAR), 12, '0'), 0 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) f FROM documents) WHERE f = 1) WHERE n <= 3""",
        "store_indexes": f"WITH d AS (SELECT doc_id, lang, source, substring({legal}, 1, 200) t FROM documents), cap AS (SELECT doc_id, coalesce({caption}, {lead}) c FROM d) SELECT 'captions' kind, doc_id chunk_id, c caption FROM cap WHERE c IS NOT NULL UNION ALL SELECT 'headings', doc_id, lang || '/' || source FROM documents UNION ALL SELECT 'defined_terms', doc_id, lang FROM documents WHERE doc_id % 4 = 2",
        "source_counts": "WITH c AS (SELECT source source_id, count(*) n FROM documents GROUP BY 1) SELECT 'all' kind, * FROM c UNION ALL SELECT 'largest', * FROM (SELECT * FROM c ORDER BY n DESC, source_id LIMIT 1) UNION ALL SELECT 'single', * FROM c WHERE n = 7 UNION ALL SELECT 'like', source, count(*) FROM documents WHERE text LIKE '%the%' GROUP BY ALL",
        "caption_samples": f"WITH d AS (SELECT doc_id, lang, source, substring({legal}, 1, 200) t FROM documents) SELECT caption FROM (SELECT doc_id, coalesce({caption}, {lead}) caption FROM d) WHERE caption IS NOT NULL ORDER BY doc_id LIMIT 20",
        "topic_representatives": """WITH t AS (SELECT source, doc_id, lang, CASE WHEN contains(lower(lang || ' ' || source), 'fr') THEN 1 WHEN contains(lower(text), 'fr') THEN 2 ELSE 3 END tier FROM documents), b AS (SELECT *, min(tier) OVER (PARTITION BY source) best FROM t),
 n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM b WHERE tier = best AND best < 3), f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) f FROM b WHERE best = 3)
 SELECT source source_id, doc_id chunk_id FROM n WHERE n <= 2 UNION ALL SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM f WHERE f = 1) WHERE n <= 2""",
        "hit_documents": vec + 'SELECT query_id, chunk_id, "rank", source doc_id FROM v JOIN documents ON doc_id = chunk_id',
        "engine_search": bm + f""", clean AS (SELECT doc_id FROM documents WHERE NOT {noise}), vq AS (SELECT vec_id query_id, embedding qv FROM embeddings JOIN benchmark ON item_id = vec_id),
 vs AS (SELECT query_id, vec_id chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM vq, embeddings),
 vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) k FROM vs),
 u AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k) "rank" FROM vr WHERE k <= 50 AND chunk_id IN (SELECT doc_id FROM clean) UNION ALL SELECT r.query_id, r.chunk_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r."rank") FROM r JOIN vq USING (query_id) WHERE r."rank" <= 50 AND r.chunk_id IN (SELECT doc_id FROM clean)),
 f AS (SELECT query_id, chunk_id, round(sum(0.5::DOUBLE / (60 + "rank")), 9) s, CASE WHEN count(*) >= 2 THEN 'hybrid' ELSE 'single' END hit_source FROM u GROUP BY 1, 2),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) k FROM f),
 t AS (SELECT query_id, chunk_id, source source_id, hit_source, s, lower(d.text) body, list_distinct(list_transform(list_filter(regexp_extract_all(b.text, '[A-Za-z0-9_]{{2,}}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')), lambda w: lower(w))) ts FROM p JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE k <= 50),
 l AS (SELECT query_id, chunk_id, source_id, hit_source, CASE WHEN len(ts) = 0 THEN s ELSE round(s * (1 + 0.5::DOUBLE * len(list_filter(ts, lambda w: contains(body, w))) / len(ts)), 9) END score FROM t),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, chunk_id) nth FROM l)
 SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) "rank", chunk_id, source_id, score, hit_source FROM c WHERE nth <= 2) WHERE "rank" <= 10""",
        "answer_sources": bm + """, vq AS (SELECT vec_id query_id, embedding qv FROM embeddings JOIN benchmark ON item_id = vec_id),
 vs AS (SELECT query_id, vec_id chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM vq, embeddings),
 vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) "rank" FROM vs),
 u AS (SELECT query_id, chunk_id, "rank" FROM vr WHERE "rank" <= 50 UNION ALL SELECT r.query_id, r.chunk_id, r."rank" FROM r JOIN vq USING (query_id) WHERE r."rank" <= 50),
 f AS (SELECT query_id, chunk_id, round(sum(0.5::DOUBLE / (60 + "rank")), 9) s FROM u GROUP BY 1, 2),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) k FROM f),
 t AS (SELECT query_id, chunk_id, source source_id, s, lower(d.text) body, list_distinct(list_transform(list_filter(regexp_extract_all(b.text, '[A-Za-z0-9_]{2,}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')), lambda w: lower(w))) ts FROM p JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE k <= 50),
 l AS (SELECT query_id, chunk_id, source_id, CASE WHEN len(ts) = 0 THEN s ELSE round(s * (1 + 0.5::DOUBLE * len(list_filter(ts, lambda w: contains(body, w))) / len(ts)), 9) END score FROM t),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, chunk_id) nth FROM l),
 h AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) "rank" FROM c WHERE query_id % 4 = 0 OR (query_id % 4 = 1 AND nth <= 2)),
 rep AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) AS INT) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) f FROM documents) WHERE f = 1) WHERE n <= 20),
 a AS (SELECT query_id, chunk_id, "rank" FROM h WHERE "rank" <= 10 UNION ALL SELECT query_id, doc_id, "rank" FROM vq, rep WHERE query_id % 4 = 2 AND "rank" <= 20)
 SELECT query_id, "rank", chunk_id, md5(text) digest FROM a JOIN documents ON doc_id = chunk_id""",
        "text_hashes": """WITH b AS (SELECT item_id, hex(encode(text)) x FROM benchmark), y AS (SELECT item_id, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substring(x, i, 2) AS UHUGEINT)) y FROM b),
 h AS (SELECT item_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, y), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) h FROM y),
 r AS (SELECT item_id, i, ((h * CAST(pow(2, i * 7 % 64) AS UHUGEINT)) % 18446744073709551616::UHUGEINT + h // CAST(pow(2, 64 - i * 7 % 64) AS UHUGEINT)) % 4294967296::UHUGEINT low FROM h, (SELECT unnest(range(0, 12)) i))
 SELECT item_id, CAST(i AS INT) dim, round(CAST(CAST((CAST(low AS DOUBLE) - CASE WHEN low >= 2147483648 THEN 4294967296 ELSE 0 END) / 2147483648 AS FLOAT) AS DOUBLE), 6) x FROM r""",
        "weight_sweep": vec + mean('SELECT CAST(k AS INT) run_id, query_id, chunk_id, "rank" FROM v, (SELECT unnest([3, 5, 10]) k) WHERE "rank" <= k', "run_id,"),
        "metrics_summary": vec + mean('SELECT 1 run_id, query_id, chunk_id, "rank" FROM v'),
        "golden_granularity": """WITH r AS (SELECT 'docs' kind, CAST(doc_id AS VARCHAR) id FROM labels UNION ALL SELECT 'parents', source FROM documents UNION ALL SELECT 'others', url FROM pages),
 f AS (SELECT kind, bool_and(id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)) d, bool_and(id IN (SELECT source FROM documents WHERE source IS NOT NULL)) p FROM r GROUP BY 1)
 SELECT kind, CASE WHEN d THEN 'doc' WHEN p THEN 'parent' ELSE 'doc' END granularity FROM f""",
        "corpus_signals": f"""WITH d AS (SELECT doc_id, lang, source, {legal} t FROM documents), cap AS (SELECT doc_id, t, coalesce({caption}, {lead}) c FROM d), first AS (SELECT t, c FROM cap WHERE c IS NOT NULL ORDER BY doc_id LIMIT 256),
 b AS (SELECT regexp_replace(substring(t, 1, instr(t, c) - 1) || substring(t, instr(t, c) + length(c)), '\\s+', '', 'g') t, regexp_replace(c, '\\s+', '', 'g') c FROM first), g AS (SELECT {bi.format('t')} tb, {bi.format('c')} cb FROM b)
 SELECT 'specific' kind, round(avg(CAST({specific} AS DOUBLE)), 9) "value" FROM (SELECT {asked} q FROM benchmark) UNION ALL SELECT 'caption_length', round(avg(length(c)), 9) FROM cap WHERE length(c) > 0
 UNION ALL SELECT 'novelty', round(avg(CASE WHEN len(tb) = 0 THEN 0.0 ELSE CAST(len(list_filter(tb, lambda x: NOT list_contains(cb, x))) AS DOUBLE) / len(tb) END), 9) FROM g""",
        "title_match": f"""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) p FROM pages), first AS (SELECT regexp_replace(trim(p[len(p)]), '\\s+', '', 'g') t FROM h WHERE trim(p[len(p)]) <> '' ORDER BY page_id LIMIT 256), tb AS (SELECT {bi.format('t')} b FROM first), q AS (SELECT item_id query_id, regexp_replace(text, '\\s+', '', 'g') t FROM benchmark), qb AS (SELECT query_id, {bi.format('t')} b FROM q)
 SELECT query_id, round(max(CAST(len(list_intersect(qb.b, tb.b)) AS DOUBLE) / len(qb.b)), 9) recall FROM qb, tb GROUP BY 1""",
        "article_leads": f"WITH d AS (SELECT doc_id, lang, source, {legal} t FROM documents) SELECT doc_id, {lead} lead, {terms} terms, contains(substring(t, 1, 12), '条例') AND regexp_matches(substring(t, 1, 12), '改正|全改|追加|削除|旧') revision, coalesce({caption}, {lead}) caption FROM d",
        "specific_queries": f"SELECT item_id, {specific} specific, CASE WHEN trim(q) = '' OR (NOT regexp_matches(q, '[一-鿿0-9０-９]') AND length(trim(q)) <= 8) THEN 'smalltalk' WHEN regexp_matches(q, '第[0-9０-９]+条|(?i:article [0-9])') THEN 'lookup' END intent FROM (SELECT item_id, {asked} q FROM benchmark)",
        "model_replies": f"""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'compare' WHEN 1 THEN 'summary' ELSE 'lookup' END kind, CASE WHEN item_id % 4 = 0 THEN trim(substring(replace(text, chr(10), ' '), 1, 12)) END topic, CASE WHEN item_id % 4 = 0 THEN 'a|b|c' ELSE '' END sources,
 array_to_string(list_filter([regexp_replace(regexp_replace(substring(replace(text, chr(10), ' '), 1, 20), '^\\s+|\\s+$', '', 'g'), '^["''「]+|["''」]+$', '', 'g'), regexp_replace('"' || substring(replace(text, chr(10), ' '), 5, 20) || '"', '^["''「]+|["''」]+$', '', 'g'), regexp_replace(regexp_replace(substring(replace(text, chr(10), ' '), 9, 15), '^\\s+|\\s+$', '', 'g'), '^["''「]+|["''」]+$', '', 'g')], lambda x: x <> ''), '|') items,
 CAST('0.' || item_id % 10 AS DOUBLE) number, item_id % 3 <> 2 refusal, CAST(3 AS BIGINT) n_variants FROM benchmark""",
        "expanded_queries": "SELECT item_id, array_to_string(list_filter([regexp_replace(regexp_replace(split_part(substring(text, 1, 30), chr(10), 1), '^\\s+|\\s+$', '', 'g'), '^[\"「」『』''*#-]+|[\"「」『』''*#-]+$', '', 'g'), regexp_replace(split_part(substring(text, 2, 20), chr(10), 1), '^\\s+|\\s+$', '', 'g'), CASE WHEN length(trim(split_part(text, chr(10), 1))) >= 30 THEN substring(trim(split_part(text, chr(10), 1)), 1, 240) END], lambda x: x IS NOT NULL), '|') variants FROM benchmark",
        "context_blocks": vec + "SELECT query_id, md5(string_agg('<source id=' || \"rank\" || '>' || text || '</source>', chr(10) ORDER BY \"rank\")) digest FROM v JOIN documents ON doc_id = chunk_id WHERE \"rank\" <= 5 GROUP BY 1",
        "middle_truncate": "WITH w AS (SELECT doc_id, string_split(text, ' ') t FROM documents), k AS (SELECT doc_id, CASE WHEN len(t) <= 200 THEN t ELSE t[1:40] || t[len(t) - 159:] END k FROM w) SELECT doc_id, len(k) n, md5(array_to_string(k, ' ')) digest FROM k",
        "must_include": "SELECT conv_id, turn, (contains(text, 'the') OR contains(text, 'de')) AND contains(text, 'a') ok FROM conversations WHERE role = 'assistant'",
        "sentence_spans": "WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^。.!?\\n]*[。.!?\\n]|[^。.!?\\n]+$') p FROM documents), e AS (SELECT doc_id, unnest(p) s, generate_subscripts(p, 1) i, p FROM p) SELECT doc_id, CAST(strlen(array_to_string(p[1:i - 1], '')) AS BIGINT) \"start\", CAST(strlen(array_to_string(p[1:i], '')) AS BIGINT) \"end\", md5(s) digest FROM e WHERE trim(s, ' ') <> ''",
        "fts_tokens": "SELECT doc_id, md5(trim('日本 本語 語の の本 と木 ' || array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)), ' '))) digest FROM documents",
        "compressor_sentences": "WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, '. ', '! '), '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') p FROM documents) SELECT doc_id, len(p) n, md5(array_to_string(p, '|')) digest FROM p",
        "overlap_tokens": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\\p{Han}]{2,}|[A-Za-z0-9０-９]{2,}'), lambda w: lower(w)))), ' ') tokens FROM conversations",
        "citation_check": """WITH a AS (SELECT conv_id, turn, text, regexp_extract(text || ' ', '[^。.!?\\n]*$', 0) said FROM conversations WHERE role = 'assistant'), k AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(said || '1 and 2', '[\\p{Han}]{2,}|[A-Za-z0-9０-９]{2,}'), lambda w: lower(w))) s FROM a),
 h AS (SELECT conv_id, turn + 1 turn, list_distinct(list_transform(regexp_extract_all(text, '[\\p{Han}]{2,}|[A-Za-z0-9０-９]{2,}'), lambda w: lower(w))) t FROM conversations),
 x AS (SELECT k.conv_id, k.turn, CASE WHEN t IS NULL OR (len(s) > 0 AND CAST(len(list_intersect(s, t)) AS DOUBLE) / len(s) < 0.05) THEN 1 ELSE 0 END bad FROM k LEFT JOIN h USING (conv_id, turn)) SELECT conv_id * 1000 + turn query_id, CAST(2 AS BIGINT) total, CAST(1 + bad AS BIGINT) unsupported, round((1 + bad) / 2.0::DOUBLE, 9) ratio FROM x""",
        "paragraph_blocks": "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') b, len(string_split(text, '. ')) n_pages FROM documents) SELECT doc_id, generate_subscripts(b, 1) - 1 n, md5(unnest(b)) digest, n_pages FROM p",
        "transcript_blocks": "WITH c AS (SELECT 'a/b/' || conv_id || '-' || turn || '.wav' path, conv_id || '-' || turn || '.wav' f, text, role, md5(text || chr(10) || '  ' || chr(10) || role) body FROM conversations) SELECT path, CAST(0 AS BIGINT) block_idx, md5(text) digest, 'Audio/' || f heading, body FROM c WHERE trim(text) <> '' UNION ALL SELECT path, 2, md5(role), 'Audio/' || f, body FROM c",
        "page_lines": "WITH w AS (SELECT item_id, string_split(text, ' ') w FROM benchmark), k AS (SELECT item_id, list_reverse(list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN i % 7 <> 3 AND i % 5 <> 0 AND trim(w[i + 1]) <> '' THEN w[i + 1] END), lambda x: x IS NOT NULL)) k FROM w) SELECT item_id, array_to_string(k, ' ') lines, md5(array_to_string(list_concat(['日本語'], k), chr(10))) digest FROM k",
        "compressed_texts": f"""WITH p AS (SELECT item_id, substring(text, 5, 30) q, list_filter(list_transform(regexp_extract_all(replace(text, '. ', '! '), '[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') p FROM benchmark),
 e AS (SELECT item_id, unnest(p) s, generate_subscripts(p, 1) i, len(p) n, regexp_replace(q, '\\s+', '', 'g') q FROM p), t AS (SELECT *, regexp_replace(s, '\\s+', '', 'g') t FROM e), g AS (SELECT item_id, s, i, n, {bi.format('q')} qb, {bi.format('t')} sb FROM t),
 c AS (SELECT *, CASE WHEN len(qb) = 0 THEN 0 ELSE round(CAST(len(list_intersect(qb, sb)) AS DOUBLE) / len(qb), 9) END score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) k FROM c)
 SELECT item_id, md5(string_agg(s, ' ' ORDER BY i)) digest FROM r WHERE score >= 0.2 OR k <= greatest(3, ceil(n * 0.3)) GROUP BY 1""",
        "texts_by_source": "SELECT source source_id, count(*) n, md5(string_agg(text, chr(10) ORDER BY doc_id)) digest FROM documents GROUP BY 1",
        "citation_spans": """WITH a AS (SELECT conv_id, turn, regexp_extract(regexp_replace(text, '[.!?\\s]+$', '') || ' [1].', '[^。.!?\n]*[.]$', 0) said FROM conversations WHERE role = 'assistant'),
 h AS (SELECT conv_id, turn + 1 turn, regexp_extract_all(text, '[^。.!?\n]*[。.!?\n]|[^。.!?\n]+$') p FROM conversations), e AS (SELECT conv_id, turn, unnest(p) s, generate_subscripts(p, 1) i FROM h),
 x AS (SELECT a.conv_id, a.turn, said, s, i, list_distinct(list_transform(regexp_extract_all(said, '[\\p{Han}]{2,}|[A-Za-z0-9０-９]{2,}'), lambda w: lower(w))) l, list_distinct(list_transform(regexp_extract_all(s, '[\\p{Han}]{2,}|[A-Za-z0-9０-９]{2,}'), lambda w: lower(w))) m FROM a JOIN e USING (conv_id, turn) WHERE trim(s, ' ') <> ''),
 y AS (SELECT *, CASE WHEN len(list_intersect(l, m)) = 0 THEN 0 ELSE round(CAST(len(list_intersect(l, m)) AS DOUBLE) / (len(l) + len(m) - len(list_intersect(l, m))), 9) END overlap FROM x)
 SELECT conv_id * 1000 + turn query_id, CAST(1 AS INT) "rank", md5(said) said, md5(s) sentence, overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, i) k FROM y) WHERE k = 1""",
        "sparse_text": "SELECT doc_id, md5(regexp_replace(replace(replace(text, 'the', '—'), lang, '—'), '—{2,}', '—', 'g')) digest FROM documents",
        "corpus_chunks": "SELECT CAST(doc_id AS VARCHAR) chunk_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END source_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE CAST(doc_id AS VARCHAR) END heading, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE '(' || source || ')' || chr(10) || text END) digest FROM documents",
    }
