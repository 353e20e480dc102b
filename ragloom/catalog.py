"""Queries over the library's operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_documents, catalog_index, catalog_parts, catalog_text
from .functions import text as T
from .operators import evaluation as E
from .operators import retrieval as R
from .plans.search import hybrid_search
from .sources import files as S

FLAGSHIP = "hybrid_search"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("lang").alias("notebook_id"), F.col("doc_id").alias("ord"), "text")


def _vectors(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def _vector_queries(s, d):
    return _t(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _queries(s, d):
    return _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _captions(s, d):
    return _t(s, d, "pages").select("page_id", F.explode(S.headings(F.col("html"))).alias("caption"))


def q_vector(s, d):
    return R.vector_top_k(_vector_queries(s, d), _vectors(s, d), 10).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def q_bm25(s, d):
    return R.bm25_top_k(_queries(s, d), _chunks(s, d), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def q_hybrid(s, d):
    v = _t(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return hybrid_search(_queries(s, d).join(v, "query_id"), _chunks(s, d), _vectors(s, d), 10, per_source=2)


def q_vector_scoped(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    return R.vector_top_k(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label"), 10, "label").select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def q_bm25_scoped(s, d):
    return R.bm25_top_k(_queries(s, d).withColumn("notebook_id", F.lit("en")), _chunks(s, d), 10, scope="notebook_id").select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def q_multi(s, d):
    words = F.split("query", r"\s+")
    q = _queries(s, d)
    part = lambda no, text, w: q.select("query_id", F.lit(no).alias("no"), text.alias("query"), F.lit(w).alias("weight"))
    v = part(0, F.col("query"), 1.0).unionByName(part(1, F.array_join(F.slice(words, 1, 6), " "), 0.7)).unionByName(part(2, F.array_join(F.reverse(F.slice(F.reverse(words), 1, 6)), " "), 0.7))
    v = v.withColumn("vid", F.concat_ws("/", "query_id", "no"))
    ranked = R.bm25_top_k(v.select(F.col("vid").alias("query_id"), "query"), _chunks(s, d), 20).select(F.col("query_id").alias("vid"), "chunk_id", "rank")
    return R.rrf(ranked.join(v.select("vid", "query_id", "weight"), "vid"), 10).select("query_id", "chunk_id", "rank", "score", "hit_source")


def q_rrf(s, d):
    v = q_vector(s, d).select("query_id", "chunk_id", "rank", F.lit(0.5).alias("weight"), F.col("score").alias("semantic_score"), F.lit(0).alias("ranking_no"))
    # a second ranking with scores of its own for odd chunks, none for even ones
    second = v.where("rank <= 5").withColumns({"weight": F.lit(0.25), "ranking_no": F.lit(1), "semantic_score": F.when(F.col("chunk_id") % 2 == 1, F.round(F.col("semantic_score") / 2, 5))})
    return R.rrf(v.unionByName(second), 5).select("query_id", "chunk_id", "rank", "score", "hit_source", "semantic_score")


def q_rank_cap(s, d):
    h = q_vector(s, d).join(_chunks(s, d).select("chunk_id", "source_id"), "chunk_id")
    return R.cap_per_source(h, 1).select("query_id", "chunk_id", "source_id", "score")


def q_metrics(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    golden = q, e.select(F.col("vec_id").alias("relevant_id"), "label")
    return E.metrics(q_vector(s, d), golden, 5).select("query_id", F.round("recall", 9).alias("recall"), "hit", "ndcg", F.round("rr", 9).alias("rr"))


def q_scope_counts(s, d):
    return _chunks(s, d).groupBy("notebook_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_id").alias("n_sources"))


def q_neighbours(s, d):
    c = _chunks(s, d)
    return R.neighbours(c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("hit_id"), "source_id", "ord"), c, 40).select("hit_id", "near_id")


def q_representatives(s, d):
    c = _chunks(s, d).withColumn("heading_path", F.array("notebook_id"))
    return R.representatives(c, 3).select("source_id", "chunk_id")


def q_noise(s, d):
    return _chunks(s, d).select("chunk_id", T.is_low_content(F.col("text")).alias("low"), (F.length(F.trim("text")) < 25).alias("short"))


def q_sentences(s, d):
    return _chunks(s, d).select("chunk_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def q_bigrams(s, d):
    return _queries(s, d).select("query_id", F.size(T.bigrams(F.col("query"))).cast("long").alias("n_bigrams"))


def q_windows(s, d):
    w = _chunks(s, d).select("chunk_id", F.posexplode(T.windows(F.col("text"), 350, 60)).alias("n", "piece"))
    return w.select("chunk_id", F.col("n").cast("long").alias("n"), F.length("piece").cast("long").alias("chars"), F.md5("piece").alias("digest"))


def q_headings(s, d):
    return _captions(s, d).select("page_id", "caption")


def q_caption_idf(s, d):
    return R.caption_idf(_captions(s, d).select("caption")).select("caption", "df", F.round("idf", 6).alias("idf"))


def q_caption_join(s, d):
    return R.caption_join(_queries(s, d), _captions(s, d).select("caption").distinct())


def q_prompt(s, d):
    turn = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return _t(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["line"]), "\n")).alias("prompt_md5"))


def q_ingest(s, d):
    f = _t(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("n_chars").cast("string").alias("fingerprint"), "doc_id")
    state = f.join(_t(s, d, "labels"), "doc_id").select("path", F.when(F.col("quality") == 1, F.col("fingerprint")).otherwise("old").alias("fingerprint"))
    return R.ingest_plan(f, state).select("path", "outcome", S.detect_kind(F.col("path")).alias("kind"))


def q_upsert(s, d):
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return R.upsert(o.withColumn("version", F.lit(1)), o.where("status = 'F'").withColumn("price", F.col("price") + 1).withColumn("version", F.lit(2)))


def q_recency(s, d):
    e = _t(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("ts").alias("now"))
    days = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 86_400_000_000
    return e.select("user_id", F.when(days < 7, 1.10).when(days < 30, 1.05).otherwise(1.0).alias("boost"))


QUERIES = {
    "hybrid_search": q_hybrid, "vector_top_k": q_vector, "bm25_top_k": q_bm25, "rrf_fusion": q_rrf, "cap_per_source": q_rank_cap, "ir_metrics": q_metrics, "scope_counts": q_scope_counts,
    "neighbour_chunks": q_neighbours, "representatives": q_representatives, "noise_filter": q_noise, "sentence_split": q_sentences, "char_bigrams": q_bigrams, "sliding_windows": q_windows,
    "page_headings": q_headings, "caption_idf": q_caption_idf, "caption_overlap_join": q_caption_join, "prompt_assembly": q_prompt, "ingest_plan": q_ingest, "upsert": q_upsert, "recency_boost": q_recency,
    "vector_top_k_scoped": q_vector_scoped, "bm25_top_k_scoped": q_bm25_scoped, "multi_query_rrf": q_multi,
    **catalog_text.QUERIES,
    **catalog_documents.QUERIES,
    **catalog_parts.QUERIES,
    **catalog_index.QUERIES,
}

_VEC = """WITH q AS (SELECT vec_id query_id, embedding qv FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM q, embeddings),
 r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS INT) "rank", round(sc, 5) score FROM s),
 v AS (SELECT * FROM r WHERE "rank" <= 10) """
_BM = """WITH tok AS (SELECT doc_id chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM documents),
 post AS (SELECT term, chunk_id, count(*) tf FROM tok GROUP BY 1, 2), dl AS (SELECT d.doc_id chunk_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) l FROM documents d),
 st AS (SELECT count(*) n, avg(l) a FROM dl), qt AS (SELECT query_id, term, count(*) qf FROM (SELECT item_id query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM benchmark) GROUP BY 1, 2),
 df AS (SELECT term, count(*) df FROM post GROUP BY 1),
 sc AS (SELECT query_id, post.chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)) * qf), 6) s FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl ON dl.chunk_id = post.chunk_id, st GROUP BY 1, 2),
 r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INT) "rank", round(s, 4) score FROM sc) """
_HEAD = """WITH h AS (SELECT page_id, trim(regexp_replace(x, '<[^>]*>', '', 'g')) caption FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) x FROM pages)) """
_BI = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))) END"

ORACLE = {
    "vector_top_k": _VEC + "SELECT * FROM v",
    "bm25_top_k": _BM + 'SELECT * FROM r WHERE "rank" <= 10',
    "rrf_fusion": _VEC + """, u AS (SELECT query_id, chunk_id, "rank", 0.5 w, score ss, 0 no FROM v UNION ALL SELECT query_id, chunk_id, "rank", 0.25, CASE WHEN chunk_id % 2 = 1 THEN round(score / 2, 5) END, 1 FROM v WHERE "rank" <= 5),
 f AS (SELECT query_id, chunk_id, round(sum(CAST(w AS DOUBLE) / (60 + "rank")), 9) score, CASE WHEN count(*) >= 2 THEN 'hybrid' ELSE 'single' END hit_source, coalesce(max(CASE WHEN no = 1 THEN ss END), max(ss)) semantic_score FROM u GROUP BY 1, 2)
 SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) "rank", score, hit_source, semantic_score FROM f) WHERE "rank" <= 5""",
    "cap_per_source": _VEC + "SELECT query_id, chunk_id, source_id, score FROM (SELECT v.*, source source_id, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) nth FROM v JOIN documents ON doc_id = chunk_id) WHERE nth <= 1",
    "ir_metrics": _VEC + """, g AS (SELECT DISTINCT a.vec_id query_id, b.vec_id chunk_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0), n AS (SELECT query_id, count(*) n FROM g GROUP BY 1),
 f AS (SELECT query_id, sum(CASE WHEN "rank" <= 5 THEN 1 ELSE 0 END) m, sum(CASE WHEN "rank" <= 5 THEN 1 / log2("rank" + 1) ELSE 0 END) dcg, min("rank") best FROM v JOIN g USING (query_id, chunk_id) GROUP BY 1)
 SELECT query_id, round(coalesce(CAST(m AS DOUBLE) / n, 0), 9) recall, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END hit, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 9) ndcg, round(coalesce(1.0::DOUBLE / best, 0), 9) rr FROM n LEFT JOIN f USING (query_id)""",
    "scope_counts": "SELECT lang notebook_id, count(*) n_chunks, count(DISTINCT source) n_sources FROM documents GROUP BY 1",
    "neighbour_chunks": "SELECT a.doc_id hit_id, b.doc_id near_id FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id BETWEEN a.doc_id - 40 AND a.doc_id + 40 WHERE a.doc_id % 100 = 0",
    "representatives": "SELECT source_id, chunk_id FROM (SELECT source source_id, doc_id chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) f FROM documents) WHERE f = 1) WHERE n <= 3",
    "sentence_split": "SELECT doc_id chunk_id, CAST(len(list_filter(regexp_extract_all(text, '[^。.!?\\n]*[。.!?\\n]|[^。.!?\\n]+$'), lambda x: trim(x, ' ') <> '')) AS BIGINT) n_sentences FROM documents",
    "char_bigrams": "SELECT item_id query_id, CAST(len(" + _BI.format("t") + ") AS BIGINT) n_bigrams FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') t FROM benchmark)",
    "sliding_windows": "SELECT doc_id chunk_id, CAST(i AS BIGINT) n, CAST(length(substring(text, i * 290 + 1, 350)) AS BIGINT) chars, md5(substring(text, i * 290 + 1, 350)) digest FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 350) / 290.0), 0) AS BIGINT))) i FROM documents WHERE length(text) > 0)",
    "page_headings": _HEAD + "SELECT page_id, caption FROM h",
    "caption_idf": _HEAD + "SELECT caption, df, round(greatest(least(ln((n + 1.0::DOUBLE) / (df + 1)) / greatest(ln((n + 1.0::DOUBLE) / 2), 1e-6), 1.0), 0.0), 6) idf FROM (SELECT caption, count(*) df FROM h GROUP BY 1), (SELECT count(*) n FROM h)",
    "caption_overlap_join": _HEAD + ", c AS (SELECT DISTINCT caption, regexp_replace(caption, '\\s+', '', 'g') t FROM h), cb AS (SELECT caption, " + _BI.format("t") + " b FROM c), q AS (SELECT item_id query_id, regexp_replace(text, '\\s+', '', 'g') t FROM benchmark), qb AS (SELECT query_id, " + _BI.format("t") + " b FROM q), p AS (SELECT query_id, caption, len(list_intersect(qb.b, cb.b)) x, len(qb.b) + len(cb.b) y FROM qb, cb) SELECT query_id, caption, round(CAST(x AS DOUBLE) / (y - x), 9) overlap FROM p WHERE x > 0 AND round(CAST(x AS DOUBLE) / (y - x), 9) >= 0.10",
    "prompt_assembly": "SELECT conv_id, md5(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn)) prompt_md5 FROM conversations GROUP BY 1",
    "ingest_plan": "SELECT 'd/' || doc_id || '.md' path, CASE WHEN quality IS NULL THEN 'new' WHEN quality = 1 THEN 'unchanged' ELSE 'changed' END outcome, 'markdown' kind FROM documents LEFT JOIN labels USING (doc_id)",
    "upsert": "SELECT o_orderkey chunk_id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END price, o_orderstatus status, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END version FROM orders",
    "recency_boost": "SELECT user_id, CAST(CASE WHEN d < 7 THEN 1.10 WHEN d < 30 THEN 1.05 ELSE 1.0 END AS DOUBLE) boost FROM (SELECT user_id, date_diff('microsecond', min(ts), max(ts)) / 86400000000 d FROM events GROUP BY 1)",
    "noise_filter": "SELECT doc_id chunk_id, length(trim(text)) < 4 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 4 low, length(trim(text)) < 25 short FROM documents",
    "vector_top_k_scoped": _VEC.replace("embedding qv FROM", "embedding qv, label l0 FROM").replace("FROM q, embeddings", "FROM q, embeddings WHERE label = l0") + "SELECT * FROM v",
    "bm25_top_k_scoped": _BM.replace("JOIN dl ON dl.chunk_id = post.chunk_id, st GROUP", "JOIN dl ON dl.chunk_id = post.chunk_id JOIN documents ON doc_id = post.chunk_id, st WHERE lang = 'en' GROUP") + 'SELECT * FROM r WHERE "rank" <= 10',
    "multi_query_rrf": _BM.replace("WITH tok", """WITH qw AS (SELECT item_id, text, regexp_split_to_array(text, '\\s+') w FROM benchmark), qv AS (SELECT item_id, '0' no, text FROM qw UNION ALL SELECT item_id, '1', array_to_string(w[1:6], ' ') FROM qw UNION ALL SELECT item_id, '2', array_to_string(w[greatest(len(w) - 5, 1):], ' ') FROM qw), tok""").replace("SELECT item_id query_id, unnest(", "SELECT item_id || '/' || no query_id, unnest(").replace("FROM benchmark) GROUP", "FROM qv) GROUP")
    + """, u AS (SELECT CAST(split_part(query_id, '/', 1) AS BIGINT) query_id, chunk_id, "rank", CASE WHEN split_part(query_id, '/', 2) = '0' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END w FROM r WHERE "rank" <= 20),
 f AS (SELECT query_id, chunk_id, round(sum(w / (60 + "rank")), 9) score, CASE WHEN count(*) >= 2 THEN 'hybrid' ELSE 'single' END hit_source FROM u GROUP BY 1, 2)
 SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) "rank", score, hit_source FROM f) WHERE "rank" <= 10""",
    "hybrid_search": _BM + """, vq AS (SELECT vec_id query_id, embedding qv FROM embeddings JOIN benchmark ON item_id = vec_id),
 vs AS (SELECT query_id, vec_id chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM vq, embeddings),
 vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) "rank" FROM vs),
 u AS (SELECT query_id, chunk_id, "rank" FROM vr WHERE "rank" <= 50 UNION ALL SELECT r.query_id, r.chunk_id, r."rank" FROM r JOIN vq USING (query_id) WHERE r."rank" <= 50),
 f AS (SELECT query_id, chunk_id, round(sum(0.5::DOUBLE / (60 + "rank")), 9) s, CASE WHEN count(*) >= 2 THEN 'hybrid' ELSE 'single' END hit_source FROM u GROUP BY 1, 2),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) k FROM f),
 t AS (SELECT query_id, chunk_id, source source_id, hit_source, s, lower(d.text) body, list_distinct(list_transform(list_filter(regexp_extract_all(b.text, '[A-Za-z0-9_]{2,}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')), lambda w: lower(w))) ts FROM p JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE k <= 50),
 l AS (SELECT query_id, chunk_id, source_id, hit_source, CASE WHEN len(ts) = 0 THEN s ELSE round(s * (1 + 0.5::DOUBLE * len(list_filter(ts, lambda w: contains(body, w))) / len(ts)), 9) END score FROM t),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, chunk_id) nth FROM l)
 SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) "rank", chunk_id, source_id, score, hit_source FROM c WHERE nth <= 2) WHERE "rank" <= 10""",
    **catalog_text.oracle(_VEC, _HEAD, _BI),
    **catalog_documents.ORACLE,
    **catalog_parts.oracle(_VEC, _BM, _BI),
    **catalog_index.oracle(_BM),
}
