"""Further queries: boosts, signals, store operations, prompts and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contracts as K
from .functions import embed as M
from .functions import media as A
from .functions import prompts as P
from .functions import text as T
from .operators import boosts as B
from .operators import chunking as C
from .operators import evaluation as E
from .operators import retrieval as R
from .operators import signals as G
from .operators import store as D
from .sources import corpora as J
from .sources import files as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("ord"), F.array("lang", "source").alias("heading_path"), "lang", "text")


def _queries(s, d):
    return _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _captions(s, d):
    h = _t(s, d, "pages").select("page_id", F.posexplode(S.headings(F.col("html"))).alias("n", "caption"))
    return h.select((F.col("page_id") * 100 + F.col("n")).alias("chunk_id"), "caption")


def _hits(s, d):
    """Vector hits with captioned texts; the query is the beginning of the query document's text."""
    e = _t(s, d, "embeddings")
    top = R.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 10)
    c = _docs(s, d).withColumn("text", F.concat(F.lit("("), "source_id", F.lit(")\n"), "text"))
    q = _t(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    return top.withColumn("score", F.round("score", 5)).join(c.drop("ord", "lang"), "chunk_id").join(q, "query_id")


def _scored(df):
    return df.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


def q_lexical(s, d):
    return _scored(R.lexical_boost(_hits(s, d)))


def q_caption_boost(s, d):
    idf = _t(s, d, "documents").groupBy(F.col("source").alias("caption")).agg((1.0 / F.count("*")).alias("idf"))
    return _scored(B.caption_boost(_hits(s, d), 0.3, idf))


def q_heading_boost(s, d):
    return _scored(B.heading_boost(_hits(s, d), 0.3))


def q_meta_boost(s, d):
    e = _t(s, d, "events")
    made = e.groupBy(F.col("user_id").alias("chunk_id")).agg(F.unix_millis(F.min(F.col("ts").cast("timestamp"))).alias("created_at_ms"))
    now = e.agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("now_ms"))
    h = _hits(s, d).withColumn("source_id", F.col("chunk_id")).join(F.broadcast(now))
    meta = made.join(_docs(s, d).select("chunk_id", F.col("source_id").alias("title")), "chunk_id").withColumnRenamed("chunk_id", "source_id")
    return _scored(B.source_meta_boost(h, meta, F.col("now_ms")))


def q_rerank(s, d):
    h = _hits(s, d).withColumn("ce", (F.col("chunk_id") % 10) / 10)
    return B.rerank_blend(h, 0.6, 5).select("query_id", "chunk_id", F.col("new_rank").cast("int").alias("new_rank"))


def q_score_max(s, d):
    h = _hits(s, d).select("query_id", "chunk_id", "score")
    return B.score_max(h.unionByName(h.withColumn("score", F.col("score") / 2)))


def q_inject(s, d):
    none = s.createDataFrame([], "query_id long, chunk_id long, score double")
    return B.index_inject(none, _queries(s, d), _captions(s, d), 8, 0.3)


def q_pairs(s, d):
    q = _queries(s, d)
    n = q.select((F.col("query_id") - 1).alias("query_id"), F.col("query").alias("other"))
    a, b = T.bigrams(F.col("query")), T.bigrams(F.col("other"))
    return q.join(n, "query_id").select("query_id", F.round(T.jaccard(a, b), 9).alias("jaccard"), F.round(T.containment(a, b), 9).alias("containment"), F.round(T.novelty(a, b), 9).alias("novelty"))


def q_body_recall(s, d):
    return G.body_recall(_queries(s, d), _captions(s, d).select("chunk_id", F.col("caption").alias("text"))).select("query_id", F.round("recall", 9).alias("recall"))


def q_terms(s, d):
    return _queries(s, d).select("query_id", F.array_join(T.extract_terms(F.col("query")), " ").alias("terms"))


def q_noise_full(s, d):
    return _docs(s, d).select("chunk_id", T.is_low_content(F.col("text")).alias("low"), T.is_retrieval_noise(F.col("text")).alias("noise"))


def q_weight(s, d):
    return _queries(s, d).select("query_id", F.round(T.hybrid_weight(F.col("query"), 0.5), 9).alias("weight"))


def _turns(s, d):
    return _t(s, d, "conversations").select("conv_id", "turn", "role", "text")


def q_code(s, d):
    return _turns(s, d).select("conv_id", "turn", T.has_code(F.col("text")).alias("code"), P.is_summary_query(F.col("text")).alias("summary"))


def _dialogue(s, d):
    turn = F.struct("turn", "role", "text")
    ordered = F.array_sort(F.collect_list(turn))
    return _turns(s, d).groupBy("conv_id").agg(F.transform(F.filter(ordered, lambda t: t["role"] != "system"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def q_chat(s, d):
    got = _dialogue(s, d)
    return got.select("conv_id", F.md5(P.chat_prompt(F.col("turns"))).alias("chatml"), F.md5(P.gemma_prompt(F.col("turns"), F.lit("Be brief."), F.lit("And then?"))).alias("gemma"))


def q_substring(s, d):
    """Whole items, their first two words (ids from 10,000), two letters and one (20,000, 30,000), and a query that nothing has."""
    q = _queries(s, d)
    part = lambda add, text: q.select((F.col("query_id") + add).alias("query_id"), text.alias("query"))
    words = part(10_000, F.regexp_extract("query", r"^\S+ \S+", 0)).where("query <> ''")
    q = part(0, F.col("query")).unionByName(words).unionByName(part(20_000, F.substring("query", 3, 2))).unionByName(part(30_000, F.substring("query", 1, 1))).unionByName(part(40_000, F.concat("query", F.lit("\u00e9\u00e9"))))
    return D.substring_search(q, _docs(s, d), 5).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


def q_by_ids(s, d):
    return D.chunks_by_ids(_docs(s, d), _t(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))).select("chunk_id", "source_id")


def q_delete(s, d):
    return D.delete_by(_docs(s, d), _t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")), "chunk_id").select("chunk_id", "source_id")


def q_missing_golden(s, d):
    return G.missing_golden(_t(s, d, "labels").select(F.col("doc_id").alias("relevant_id")), _t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


def q_missing_pages(s, d):
    t = _turns(s, d)
    blocks = t.where("role = 'user'").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), "text")
    sizes = t.groupBy(F.col("conv_id").alias("source_id")).agg(F.max("turn").alias("n_pages"))
    return D.pages_without_text(blocks, sizes).select("source_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def q_block_at(s, d):
    t = _turns(s, d)
    return D.block_at(t.select(F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("block_idx"), "text"), t.select(F.col("conv_id").alias("source_id"), (F.col("turn") * 40).alias("pos")))


def q_faithfulness(s, d):
    t = _turns(s, d)
    was = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return t.where("role = 'assistant'").join(was, ["conv_id", "turn"]).select("conv_id", "turn", F.round(E.faithfulness(F.col("text"), F.col("context")), 9).alias("score"))


def q_faithfulness_summary(s, d):
    return E.faithfulness_summary(q_faithfulness(s, d))


def q_thesaurus(s, d):
    word = F.regexp_extract("query", r"^\S+", 0)
    q = _queries(s, d).groupBy(word.alias("term")).agg(F.min("query_id").cast("string").alias("id")).where("term <> ''")
    entries = q.select("term", F.array("id").alias("synonyms"), F.array(F.concat(F.lit("s"), "id")).alias("scenarios"), F.lit("both").alias("enrich_mode"))
    got = J.thesaurus_terms(_docs(s, d), entries)
    return got.join(_docs(s, d).select("chunk_id", "text"), "chunk_id").select("chunk_id", F.array_join("terms", ", ").alias("terms"), F.md5(P.enrich(F.concat(F.lit("(x)\n"), "text"), F.col("terms"))).alias("digest"))


def _clauses(s, d):
    risky = F.when(F.col("lang") == "en", F.concat("text", F.lit(" Unlimited Liability."))).otherwise(F.col("text"))
    return _docs(s, d).select(F.col("chunk_id").alias("doc_id"), F.lit(1).alias("clause_no"), F.when(F.col("source_id") > "m", "liability").otherwise("term").alias("category"), risky.alias("text"))


def q_risks(s, d):
    return K.risks(_clauses(s, d)).select("doc_id", "severity", "category")


def q_revisions(s, d):
    return K.revisions(_clauses(s, d)).select("doc_id", F.md5("suggestion").alias("digest"))


def q_template(s, d):
    own = _docs(s, d).select(F.col("lang").alias("doc_id"), F.col("source_id").alias("category"))
    more = s.sql("SELECT 'warranty' AS category")
    return K.missing_clauses(own.select("category").unionByName(more), own)


def q_density(s, d):
    return G.density(_docs(s, d))


def q_tokenizer(s, d):
    return G.tokenizer_signals(_docs(s, d))


def q_options(s, d):
    return G.auto_options(_docs(s, d))


def q_enrichment(s, d):
    m = G.recall_mean(_queries(s, d), _captions(s, d).select("chunk_id", F.col("caption").alias("text")))
    return m.select("recall", G.recommend_enrichment(F.col("recall")).alias("advice"))


def q_box(s, d):
    e = _t(s, d, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    return A.union_box(e, "label")


def q_resample(s, d):
    return _t(s, d, "embeddings").select("vec_id", F.explode(A.resample(F.col("embedding"), 8000, 16_000)).alias("x")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def q_projections(s, d):
    h, t = F.col("heading_path"), F.col("text")
    return _docs(s, d).select("chunk_id", F.md5(T.embedding_text(h, t)).alias("embedding_text"), F.md5(T.fts_text(h, t)).alias("fts_text"), F.md5(T.inject_caption(h, t)).alias("captioned"), T.chunk_summary(t).alias("summary"))


def q_report(s, d):
    f = _t(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").cast("string").alias("fingerprint"))
    state = _t(s, d, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("q")).join(f, "path").select("path", F.when(F.col("q") == 1, F.col("fingerprint")).otherwise("old").alias("fingerprint"))
    return R.ingest_plan(f, state).groupBy("outcome").agg(F.count("*").alias("n"))


def q_recursive(s, d):
    b = _docs(s, d).select(F.col("chunk_id").cast("string").alias("source_id"), F.lit(0).alias("block_idx"), "text", "heading_path", F.lit(None).cast("int").alias("page"))
    return C.chunk_blocks(b).select("source_id", "ord", "chunk_id", F.md5("text").alias("digest"))


QUERIES = {
    "lexical_boost": q_lexical, "caption_boost": q_caption_boost, "heading_boost": q_heading_boost, "source_meta_boost": q_meta_boost, "rerank_blend": q_rerank, "score_max_merge": q_score_max, "caption_inject": q_inject,
    "bigram_overlaps": q_pairs, "query_body_recall": q_body_recall, "extract_terms": q_terms, "retrieval_noise": q_noise_full, "weight_adjust": q_weight, "code_snippet": q_code, "chat_prompts": q_chat, "substring_search": q_substring,
    "chunks_by_ids": q_by_ids, "delete_by": q_delete, "golden_missing": q_missing_golden, "pages_without_text": q_missing_pages, "block_at_position": q_block_at, "faithfulness": q_faithfulness, "faithfulness_summary": q_faithfulness_summary,
    "thesaurus_enrich": q_thesaurus, "contract_risks": q_risks, "contract_revisions": q_revisions, "template_compare": q_template, "density_signals": q_density, "tokenizer_signals": q_tokenizer, "auto_options": q_options, "enrich_recommend": q_enrichment,
    "union_box": q_box, "linear_resample": q_resample, "text_projections": q_projections, "index_report": q_report, "recursive_chunks": q_recursive,
}


def oracle(vec: str, head: str, bi: str) -> dict[str, str]:
    """vec: v (query_id, chunk_id, rank, score) of vector hits; head: h (page_id, caption); bi: bigrams of a text."""
    hits = vec + """, h AS (SELECT v.query_id, v.chunk_id, v."rank", v.score, '(' || c.source || ')' || chr(10) || c.text AS text, c.lang, c.source, substring(q.text, 1, 60) query FROM v JOIN documents c ON c.doc_id = v.chunk_id JOIN documents q ON q.doc_id = v.query_id) """
    terms = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]{{2,}}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')), lambda w: lower(w))))"
    bare = "regexp_replace({0}, '\\s+', '', 'g')"
    jac = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))) END"
    two = hits + f", g AS (SELECT *, {bare.format('query')} qt, {bare.format('source')} st, {bare.format('lang')} lt FROM h), b AS (SELECT *, {bi.format('qt')} qb, {bi.format('st')} sb, {bi.format('lt')} lb FROM g), o AS (SELECT *, {jac.format('qb', 'sb')} so, {jac.format('qb', 'lb')} lo FROM b) "
    caps = head.replace("SELECT page_id, unnest(regexp_extract_all", "SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), 1) n, unnest(regexp_extract_all").replace("SELECT page_id, trim", "SELECT page_id * 100 + n - 1 chunk_id, trim")
    pairs = caps + f", c AS (SELECT chunk_id, caption, {bare.format('caption')} t FROM h), cb AS (SELECT chunk_id, caption, {bi.format('t')} b FROM c), q AS (SELECT item_id query_id, {bare.format('text')} t FROM benchmark), qb AS (SELECT query_id, {bi.format('t')} b FROM q), x AS (SELECT query_id, chunk_id, caption, len(qb.b) nq, len(list_intersect(qb.b, cb.b)) m, round({jac.format('qb.b', 'cb.b')}, 9) ov FROM qb, cb) "
    recall = pairs + ", r AS (SELECT query_id, coalesce(max(CASE WHEN nq > 0 THEN CAST(m AS DOUBLE) / nq END), 0.0) recall FROM x GROUP BY 1) "
    strip = "regexp_replace(regexp_replace({0}, '[、。・「」『』（）【】,.;:!?()\\[\\]\"'']', '', 'g'), '\\s+', '', 'g')"
    faith = f"WITH p AS (SELECT a.conv_id, a.turn, {strip.format('a.text')} x, {strip.format('b.text')} y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'), g AS (SELECT conv_id, turn, {bi.format('x')} xb, {bi.format('y')} yb FROM p), f AS (SELECT conv_id, turn, round(CASE WHEN len(xb) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(xb, yb)) AS DOUBLE) / len(xb) END, 9) score FROM g) "
    clauses = "WITH c AS (SELECT doc_id, CASE WHEN source > 'm' THEN 'liability' ELSE 'term' END category, CASE WHEN lang = 'en' THEN text || ' Unlimited Liability.' ELSE text END t FROM documents) "
    return {
        "lexical_boost": hits + f", t AS (SELECT *, {terms.format('query')} ts FROM h) SELECT query_id, chunk_id, round(round(CASE WHEN len(ts) = 0 THEN score ELSE score * (1 + 0.5::DOUBLE * len(list_filter(ts, lambda w: contains(lower(text), w))) / len(ts)) END, 9), 4) score FROM t",
        "caption_boost": two + ", f AS (SELECT source, 1.0::DOUBLE / count(*) w FROM documents GROUP BY 1) SELECT query_id, chunk_id, round(round(score + CASE WHEN so >= 0.10 THEN 0.3::DOUBLE * so * w ELSE 0 END, 9), 4) score FROM o JOIN f USING (source)",
        "heading_boost": two + "SELECT query_id, chunk_id, round(round(score + 0.3::DOUBLE * greatest(so, lo), 9), 4) score FROM o",
        "source_meta_boost": hits + f", m AS (SELECT user_id, min(ts) t0 FROM events GROUP BY 1), n AS (SELECT max(ts) t1 FROM events), t AS (SELECT h.*, {terms.format('query')} ts, lower(source) ti, (epoch_ms(t1) - epoch_ms(t0)) / 86400000.0::DOUBLE age FROM h LEFT JOIN m ON m.user_id = h.chunk_id, n) SELECT query_id, chunk_id, round(round(score * (1 + CASE WHEN age IS NULL THEN 0 ELSE CASE WHEN len(list_filter(ts, lambda w: contains(ti, w))) > 0 OR (length(query) >= 3 AND contains(ti, lower(query))) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN age < 7 THEN 0.10::DOUBLE WHEN age < 30 THEN 0.05::DOUBLE ELSE 0 END END), 9), 4) score FROM t",
        "rerank_blend": hits + ", m AS (SELECT query_id, greatest(max(CASE WHEN \"rank\" <= 5 THEN abs(score) END), 1e-6) top, count(*) FILTER (\"rank\" <= 5) n FROM h GROUP BY 1), b AS (SELECT h.query_id, chunk_id, \"rank\" r, CASE WHEN \"rank\" <= 5 AND n > 1 THEN round(0.6::DOUBLE * ((chunk_id % 10) / 10.0::DOUBLE) + 0.4::DOUBLE * greatest(least(score / top, 1.0::DOUBLE), 0.0::DOUBLE), 9) END bl FROM h JOIN m USING (query_id)) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= 5 THEN 0 ELSE 1 END, bl DESC NULLS LAST, r) AS INT) new_rank FROM b",
        "score_max_merge": hits + "SELECT query_id, chunk_id, greatest(score, score / 2) score FROM h",
        "caption_inject": pairs + ", r AS (SELECT query_id, chunk_id, ov, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, chunk_id) n FROM x WHERE ov >= 0.10) SELECT query_id, chunk_id, round(0.3::DOUBLE * ov, 9) score FROM r WHERE n <= 8",
        "bigram_overlaps": f"WITH q AS (SELECT a.item_id query_id, {bare.format('a.text')} x, {bare.format('b.text')} y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), g AS (SELECT query_id, {bi.format('x')} xb, {bi.format('y')} yb FROM q) SELECT query_id, round({jac.format('xb', 'yb')}, 9) jaccard, round(CASE WHEN len(xb) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(xb, yb)) AS DOUBLE) / len(xb) END, 9) containment, round(CASE WHEN len(xb) = 0 THEN 0.0::DOUBLE ELSE CAST(len(xb) - len(list_intersect(xb, yb)) AS DOUBLE) / len(xb) END, 9) novelty FROM g",
        "query_body_recall": recall + "SELECT query_id, round(recall, 9) recall FROM r",
        "enrich_recommend": recall + "SELECT round(avg(recall), 9) recall, CASE WHEN round(avg(recall), 9) < 0.30 THEN 'on' WHEN round(avg(recall), 9) < 0.40 THEN 'uncertain' ELSE 'off' END advice FROM r",
        "extract_terms": f"SELECT item_id query_id, array_to_string({terms.format('text')}, ' ') terms FROM benchmark",
        "retrieval_noise": "WITH t AS (SELECT doc_id chunk_id, text, trim(text) t, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) n FROM documents) SELECT chunk_id, length(t) < 4 OR n < 4 low, t = '' OR n < 25 OR (length(t) < 60 AND length(regexp_replace(t, '[^.・…─━·]', '', 'g')) * 10 >= length(t) * 3) OR len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(trim(l), '^[0-9][^.]{0,6}\\.'))) >= 2 noise FROM t",
        "weight_adjust": "WITH t AS (SELECT item_id query_id, text, length(regexp_replace(text, '\\s', '', 'g')) n, length(regexp_replace(text, '[^぀-ヿ]', '', 'g')) k, length(regexp_replace(text, '[^一-鿿A-Za-z0-9０-９]', '', 'g')) o FROM benchmark) SELECT query_id, CASE WHEN length(text) < 4 OR n = 0 THEN 0.5::DOUBLE ELSE round(greatest(least(0.5::DOUBLE + greatest(least(CAST(k AS DOUBLE) / n - CAST(o AS DOUBLE) / n, 1.0::DOUBLE), -1.0::DOUBLE) * 0.2::DOUBLE, 0.95::DOUBLE), 0.05::DOUBLE), 9) END weight FROM t",
        "code_snippet": "SELECT conv_id, turn, regexp_matches(text, '[A-Z_]{4}') OR length(regexp_replace(text, '[^(){};=%<>]', '', 'g')) >= 2 OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: contains(w, '_') AND length(w) >= 4)) > 0 OR len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 5 AND regexp_matches(w, '^[A-Z][A-Za-z]+[A-Z]'))) > 0 code, regexp_matches(lower(text), '要約|概要|全体像|要点|まとめて|について教えて|summary|summarize|overview') summary FROM conversations",
        "chat_prompts": "WITH t AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) f FROM conversations), g AS (SELECT conv_id, any_value(f) f, coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role <> 'system'), '') c, coalesce(string_agg('<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || chr(10) || CASE WHEN turn = f THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || text || '<end_of_turn>' || chr(10), '' ORDER BY turn) FILTER (role <> 'system'), '') m FROM t GROUP BY 1) SELECT conv_id, md5(c || '<|im_start|>assistant' || chr(10)) chatml, md5(m || '<start_of_turn>user' || chr(10) || CASE WHEN f IS NULL THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || 'And then?<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)) gemma FROM g",
        "substring_search": "WITH b AS (SELECT item_id, text FROM benchmark), q AS (SELECT item_id query_id, lower(text) q FROM b UNION ALL SELECT item_id + 10000, lower(regexp_extract(text, '^\\S+ \\S+')) FROM b WHERE regexp_extract(text, '^\\S+ \\S+') <> '' UNION ALL SELECT item_id + 20000, lower(substring(text, 3, 2)) FROM b UNION ALL SELECT item_id + 30000, lower(substring(text, 1, 1)) FROM b UNION ALL SELECT item_id + 40000, lower(text) || 'éé' FROM b) SELECT * FROM (SELECT query_id, doc_id chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) \"rank\" FROM q JOIN documents ON contains(lower(text), q)) WHERE \"rank\" <= 5",
        "chunks_by_ids": "SELECT doc_id chunk_id, source source_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "delete_by": "SELECT doc_id chunk_id, source source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "golden_missing": "SELECT doc_id relevant_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "pages_without_text": "WITH m AS (SELECT conv_id, max(turn) n FROM conversations GROUP BY 1), p AS (SELECT conv_id, unnest(range(1, n + 1)) p FROM m), k AS (SELECT p.conv_id, p FROM p WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = p.conv_id AND c.turn = p.p AND c.role = 'user' AND trim(c.text) <> '')) SELECT m.conv_id source_id, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') pages FROM m LEFT JOIN k USING (conv_id) GROUP BY 1",
        "block_at_position": "WITH b AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) p0 FROM conversations) SELECT c.conv_id source_id, c.turn * 40 pos, (SELECT CAST(max(b.turn) AS INT) FROM b WHERE b.conv_id = c.conv_id AND b.p0 <= c.turn * 40) block_idx FROM conversations c",
        "faithfulness": faith + "SELECT * FROM f",
        "faithfulness_summary": faith + "SELECT round(coalesce(avg(score), 0), 9) mean, round(coalesce(min(score), 0), 9) low, round(coalesce(max(score), 0), 9) high FROM f",
        "thesaurus_enrich": "WITH e AS (SELECT term, CAST(min(item_id) AS VARCHAR) id FROM (SELECT item_id, regexp_extract(text, '^\\S+') term FROM benchmark) WHERE term <> '' GROUP BY 1), x AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) n FROM documents JOIN e ON contains(substring(text, 1, 200), term)), u AS (SELECT DISTINCT doc_id, unnest([id, 's' || id]) w FROM x WHERE n <= 3), g AS (SELECT doc_id, string_agg(w, ', ' ORDER BY w) terms FROM u GROUP BY 1) SELECT g.doc_id chunk_id, terms, md5('(x ｜ シナリオ: ' || terms || ')' || chr(10) || text) digest FROM g JOIN documents d ON d.doc_id = g.doc_id",
        "contract_risks": clauses + "SELECT doc_id, 'high' severity, 'liability' category FROM c WHERE contains(lower(t), 'unlimited liability')",
        "contract_revisions": clauses + "SELECT doc_id, md5(regexp_replace(t, '(?i)unlimited liability', 'liability capped at the fees paid', 'g')) digest FROM c WHERE category = 'liability' AND contains(lower(t), 'unlimited liability')",
        "template_compare": "SELECT a.lang doc_id, k.category FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT source category FROM documents UNION SELECT 'warranty') k WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = a.lang AND d.source = k.category)",
        "density_signals": "SELECT count(*) n_chunks, round(avg(CASE WHEN regexp_matches(text, '^\\([^)]+\\)') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) caption_density, round(avg(CASE WHEN length(lang || ' ' || source) >= 8 AND regexp_matches(lang || ' ' || source, '[^\\x00-\\x7F]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) heading_density FROM documents",
        "tokenizer_signals": "SELECT CAST(sum(length(text)) AS BIGINT) total_chars, round(CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS DOUBLE) / sum(length(text)), 9) en_ratio, bool_or(regexp_matches(text, '[０-９]')) has_wide_digit, bool_or(regexp_matches(text, '[一二三四五六七八九十百千万〇零]')) has_kanji_digit, 'bigram_nfkc' tokenizer FROM documents",
        "auto_options": "SELECT avg(CASE WHEN length(lang || ' ' || source) >= 8 AND regexp_matches(lang || ' ' || source, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0.0 END) >= 0.8 heading_boost, CASE WHEN count(DISTINCT source) >= 3 THEN 1 ELSE 0 END per_source FROM documents",
        "union_box": "SELECT label, min(CAST(embedding[1] AS DOUBLE)) x0, min(CAST(embedding[2] AS DOUBLE)) y0, max(CAST(embedding[3] AS DOUBLE)) x1, max(CAST(embedding[4] AS DOUBLE)) y1 FROM embeddings WHERE embedding[1] <> 0 OR embedding[2] <> 0 OR embedding[3] <> 0 OR embedding[4] <> 0 GROUP BY 1",
        "linear_resample": "SELECT vec_id, count(*) n, round(sum((CAST(embedding[i // 2 + 1] AS DOUBLE) + CAST(embedding[CASE WHEN i % 2 = 1 THEN least(i // 2 + 2, len(embedding)) ELSE i // 2 + 1 END] AS DOUBLE)) / 2), 4) total FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) * 2)) i FROM embeddings) GROUP BY 1",
        "text_projections": "SELECT doc_id chunk_id, md5(lang || ' / ' || source || chr(10) || text) embedding_text, md5(lang || ' ' || source || chr(10) || text) fts_text, md5(CASE WHEN trim(source) = '' OR regexp_matches(source, '[()（）]') OR starts_with(ltrim(text), '(') THEN text ELSE '(' || trim(source) || ')' || chr(10) || text END) captioned, substring(string_split(text, chr(10))[1], 1, 80) summary FROM documents",
        "index_report": "SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN quality = 1 THEN 'unchanged' ELSE 'changed' END outcome, count(*) n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
    }
