"""Queries over kept tables: the store's snapshots, streams into it, and indexes of terms, grams and patterns; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embed as M
from .functions import prompts as P
from .operators import chunking as C
from .operators import evaluation as E
from .operators import retrieval as R
from .operators import store as D
from .operators.term_index import TermIndex
from .plans import parts
from .plans.ingest import IndexCache, Ingest
from .sources import corpora as J
from .sources import files as S
from .sources.scratch import shared_folder
from .streaming.ingest import ingest_stream


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q_store_snapshot(s, d):
    """The store after upserts, deletions and a compaction, each state read from its snapshot."""
    store = D.ChunkStore(s, shared_folder(s, "store"))
    docs = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("ord"), "text", F.col("lang").alias("notebook_id"))
    state = lambda name: store.chunks().select(F.lit(name).alias("state"), "notebook_id", "chunk_id", "source_id", F.md5("text").alias("digest"))
    store.upsert(docs, 1)
    store.upsert(docs.where("ord % 3 = 0").withColumn("text", F.concat("text", F.lit(" (new)"))), 2, replace=s.createDataFrame([("en", "src1")], "notebook_id string, source_id string"))
    first = state("upserted")
    store.delete_sources("fr", docs.where("source_id like '%2'"), 3)
    store.delete_by_notebook("es", 4)
    store.upsert(docs.where("notebook_id = 'es' and ord % 2 = 0"), 5)
    second = state("deleted")
    third = store.compact().chunks().select(F.lit("compacted").alias("state"), "notebook_id", "chunk_id", "source_id", F.md5("text").alias("digest"))
    return first.unionByName(second).unionByName(third)


_SNAPSHOT = """WITH u AS (SELECT lang, doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text || ' (new)' ELSE text END t FROM documents WHERE doc_id % 3 = 0 OR lang IS DISTINCT FROM 'en' OR source IS DISTINCT FROM 'src1'),
 x AS (SELECT lang, doc_id, source, t FROM u WHERE lang <> 'es' AND NOT (lang = 'fr' AND source LIKE '%2') UNION ALL SELECT lang, doc_id, source, text FROM documents WHERE lang = 'es' AND doc_id % 2 = 0),
 a AS (SELECT 'upserted' s, * FROM u UNION ALL SELECT 'deleted', * FROM x UNION ALL SELECT 'compacted', * FROM x)
 SELECT s state, lang notebook_id, CAST(doc_id AS VARCHAR) chunk_id, source source_id, md5(t) digest FROM a"""


def q_stream_ingest(s, d):
    """A feed of three waves, read as a stream in several batches and then once more under the same name."""
    feed = shared_folder(s, "feed")
    docs = _t(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id", "text")
    older = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text"))
    for wave, (which, text) in enumerate((("doc_id % 7 <> 0", older), ("doc_id % 2 = 0", F.col("text")), ("doc_id % 2 = 1 or doc_id % 5 = 0", F.col("text")))):
        rows = docs.where(which).withColumn("text", text)
        rows = rows.select("path", S.detect_kind(F.col("path")).alias("kind"), F.md5("text").alias("fingerprint"), F.col("text").cast("binary").alias("content"), F.lit(wave).cast("long").alias("modified"))
        # small row groups: a batch is fewer files than there are cores, and a group is read by one task
        rows.write.option("parquet.block.size", 4 << 20).parquet(f"{feed}/wave-{wave}")
    store = D.ChunkStore(s, shared_folder(s, "store"))
    ingest = Ingest(store, lambda t: M.bigram_embedding(t, 16), parts.WindowChunker(350, 60), cache=IndexCache(s, shared_folder(s, "state")))
    many = max(s.sparkContext.defaultParallelism // 2, 1)
    for turn in range(2):
        ingest_stream(s, feed, ingest, "all", shared_folder(s, f"checkpoint-{turn}"), "feed", files=many).awaitTermination()
    store.settle()
    return store.chunks("all").select("source_id", "ord", F.md5("text").alias("digest"), F.size("embedding").alias("dims"))


_STREAM = """SELECT sha256('d/' || doc_id || '.txt') source_id, CAST(i AS INT) ord, md5(substring(text, i * 290 + 1, 350)) digest, CAST(16 AS INT) dims
 FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 350) / 290.0), 0) AS BIGINT))) i FROM documents WHERE length(text) > 0)"""


def _chunks(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _queries(s, d):
    return _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def q_bm25_index(s, d):
    """BM25 from the term index: the buckets of the query terms alone are read."""
    index = TermIndex.build(_chunks(s, d), shared_folder(s, "terms"))
    return index.top_k(_queries(s, d), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


#: Entries of the items: the second and third word are the term, two words and three words after them the synonyms.
_ENTRY = "array_join(slice(w, 2, 2), ' ')", ("array_join(slice(w, 4, 2), ' ')", "array_join(slice(w, 6, 3), ' ')", "'the'")


def q_sparse_corpus(s, d):
    """Documents without the synonyms of the entries that their heads name."""
    items = _t(s, d, "benchmark").select(F.split("text", r"\s+").alias("w"), "item_id").where("size(w) >= 8")
    entries = items.groupBy(F.expr(_ENTRY[0]).alias("term")).agg(F.min(F.struct("item_id", F.array(*[F.expr(x) for x in _ENTRY[1]]).alias("synonyms"))).alias("x")).select("term", "x.synonyms")
    corpus = _t(s, d, "documents").select("doc_id", F.lit("the").alias("caption"), F.concat(F.when(F.col("doc_id") % 3 == 0, "the。").otherwise(""), "text").alias("text"))
    heads = _t(s, d, "documents").where("doc_id % 7 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.col("source").alias("caption"), F.substring("text", 1, 2000).alias("text"))
    return J.sparse_corpus(corpus.unionByName(heads), entries).select("doc_id", F.md5("text").alias("digest"))


def q_weight_grid(s, d):
    """One hybrid retrieval, scored at five weights; items of one label are relevant to each other."""
    e = _t(s, d, "embeddings").select("vec_id", "label", "embedding")
    q = _queries(s, d).join(e, F.col("query_id") == F.col("vec_id")).drop("vec_id")
    golden = q.select("query_id", "label"), e.select(F.col("vec_id").alias("relevant_id"), "label")
    vectors = R.vector_top_k(q.select("query_id", F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 50)
    return E.weight_grid(vectors, R.bm25_top_k(q.select("query_id", "query"), _chunks(s, d), 50), golden, [0.0, 0.25, 0.5, 0.75, 1.0], 10)


def q_refusals(s, d):
    """Answers that hold a refusal among more and more of an item's words: refusals, and their faithfulness to other words."""
    phrases = F.explode(F.array(*[F.lit(x) for x in P.REFUSALS])).alias("phrase")
    made = _t(s, d, "benchmark").select("item_id", "text", phrases).select("item_id", "phrase", "text", F.explode(F.array(*[F.lit(n) for n in (0, 4, 12, 20, 30, 60)])).alias("more"))
    answer = F.concat("phrase", F.expr("substring(text, 1, more)"))
    scored = made.select("item_id", "phrase", "more", P.looks_like_refusal(answer).alias("refusal"), E.faithfulness(answer, F.lit("zq")).alias("score"))
    return scored.withColumn("score", F.when(F.col("refusal"), F.col("score")).otherwise(-1.0))


#: Wide forms of the small letters, which the compatibility form makes plain.
_PLAIN, _WIDE = "abcdefghijklmnopqrstuvwxyz", "".join(chr(ord(x) + 0xFEE0) for x in "abcdefghijklmnopqrstuvwxyz")


def q_nfkc(s, d):
    """Texts of wide letters and ligatures, made plain."""
    wide = F.translate("text", _PLAIN, _WIDE)
    text = F.when(F.col("doc_id") % 3 == 0, wide).when(F.col("doc_id") % 3 == 1, F.replace(F.col("text"), F.lit("fi"), F.lit("\ufb01"))).otherwise(F.col("text"))
    return _t(s, d, "documents").select("doc_id", F.md5(M.nfkc(text)).alias("digest"))


def q_hash_embed(s, d):
    """Dimensions of the bigram embedding of each document, the strongest first, of equal ones the least first."""
    v = _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), M.bigram_embedding(F.col("text")).alias("v"))
    ranked = F.array_sort(F.filter(F.transform("v", lambda x, i: F.struct((-x).alias("x"), i.alias("i"))), lambda p: p["x"] < 0))
    norm = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4)
    return v.select("chunk_id", F.size(ranked).alias("dims"), F.md5(F.array_join(F.transform(ranked, lambda p: p["i"].cast("string")), ",")).alias("ranked"), F.when(F.size(ranked) > 0, norm).otherwise(0.0).alias("norm"))


QUERIES = {"refusals": q_refusals, "nfkc_texts": q_nfkc, "hash_embedding": q_hash_embed, "store_snapshot": q_store_snapshot, "stream_ingest": q_stream_ingest, "bm25_index": q_bm25_index, "sparse_corpus": q_sparse_corpus, "weight_grid": q_weight_grid}

_SPARSE = """WITH b AS (SELECT item_id, regexp_split_to_array(text, '\\s+') w FROM benchmark), e0 AS (SELECT array_to_string(w[2:3], ' ') term, item_id, [array_to_string(w[4:5], ' '), array_to_string(w[6:8], ' '), 'the'] syn FROM b WHERE len(w) >= 8),
 e AS (SELECT term, arg_min(syn, item_id) syn FROM e0 GROUP BY 1),
 s AS (SELECT term, list(x ORDER BY length(x) DESC, i) syn FROM (SELECT term, unnest(syn) x, unnest(range(len(syn))) i FROM e) GROUP BY 1),
 c AS (SELECT doc_id, 'the' caption, CASE WHEN doc_id % 3 = 0 THEN 'the。' ELSE '' END || text t FROM documents UNION ALL SELECT doc_id + 1000000, source, substring(text, 1, 2000) FROM documents WHERE doc_id % 7 = 0),
 h AS (SELECT doc_id, term, syn, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) n FROM c JOIN s ON contains(substring(caption || t, 1, 300), term)),
 g AS (SELECT doc_id, list(x ORDER BY n, i) syns FROM (SELECT doc_id, n, unnest(syn) x, unnest(range(len(syn))) i FROM h WHERE n <= 3) JOIN c USING (doc_id) WHERE x <> caption AND x <> '' GROUP BY 1),
 r AS (SELECT doc_id, list_reduce(list_prepend(t, coalesce(syns, [])), lambda a, x: replace(a, x, '—')) t FROM c LEFT JOIN g USING (doc_id))
 SELECT doc_id, md5(replace(replace(regexp_replace(t, '—{2,}', '—', 'g'), '—。', '。'), '。—', '。')) digest FROM r"""


def _recursive() -> str:
    """recursive_chunks: a level for each separator, pieces kept in order by their path."""
    ctes, last = ["l0 AS (SELECT doc_id, [0] path, coalesce(text, '') t FROM documents)"], 0
    for sep in C.SEPARATORS[:-1]:
        q = " || ".join("chr(10)" for _ in sep) if sep.strip("\n") == "" else f"'{sep}'"
        units = f"list_filter(list_transform(range(1, len(string_split(t, {q})) + 1), lambda i: string_split(t, {q})[i] || CASE WHEN i < len(string_split(t, {q})) THEN {q} ELSE '' END), lambda u: u <> '')"
        fold = "list_reduce(list_prepend([''], list_transform(u, lambda x: [x])), lambda a, x: CASE WHEN a[len(a)] <> '' AND length(a[len(a)]) + length(x[1]) > 350 THEN list_append(a, right(a[len(a)], 60) || x[1]) ELSE list_append(a[1:len(a) - 1], a[len(a)] || x[1]) END)"
        ctes.append(f"u{last} AS (SELECT doc_id, path, {units} u FROM l{last} WHERE length(t) > 600)")
        ctes.append(f"p{last} AS (SELECT doc_id, path, {fold} p FROM u{last})")
        ctes.append(f"l{last + 1} AS (SELECT doc_id, list_append(path, 0) path, t FROM l{last} WHERE length(t) <= 600 UNION ALL SELECT doc_id, list_append(path, i), p[i] FROM (SELECT doc_id, path, p, unnest(range(1, len(p) + 1)) i FROM p{last}))")
        last += 1
    ctes.append(f"w AS (SELECT doc_id, list_append(path, 0) path, t FROM l{last} WHERE length(t) <= 600 UNION ALL SELECT doc_id, list_append(path, i), substring(t, i * 290 + 1, 350) FROM (SELECT doc_id, path, t, unnest(range(0, 1 + CAST(ceil((length(t) - 350) / 290.0) AS BIGINT))) i FROM l{last} WHERE length(t) > 600))")
    ctes.append("f AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY path) rn FROM w WHERE length(trim(t, ' ')) >= 4 AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 4)")
    ctes.append("o AS (SELECT doc_id, t, rn, sum(CASE WHEN length(t) < 80 AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY rn) - 1 ord FROM f)")
    return "WITH " + ",\n ".join(ctes) + "\n SELECT CAST(doc_id AS VARCHAR) source_id, CAST(ord AS INT) ord, sha256(doc_id || '|' || CAST(ord AS INT)) chunk_id, md5(string_agg(t, chr(10) ORDER BY rn)) digest FROM o GROUP BY doc_id, ord"


_HASHED = """WITH d AS (SELECT doc_id, text t, length(text) n FROM documents),
 g AS (SELECT doc_id, CASE WHEN n = 1 THEN t ELSE substring(t, i, 2) END g FROM (SELECT doc_id, t, n, unnest(range(1, greatest(n, 2))) i FROM d WHERE n > 0)),
 c AS (SELECT doc_id, g, count(*) c FROM g GROUP BY 1, 2),
 b AS (SELECT g, list_transform(range(0, length(hex(encode(g))) // 2), lambda i: CAST('0x' || substring(hex(encode(g)), 2 * i + 1, 2) AS INT)) b FROM (SELECT DISTINCT g FROM c)),
 h AS (SELECT g, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(b, lambda x: CAST(x AS HUGEINT))), lambda a, x: (CAST(xor(CAST(a AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * 1099511628211) % 18446744073709551616) h FROM b),
 e AS (SELECT doc_id, CAST(h % 256 AS INT) dim, sum(c) c FROM c JOIN h USING (g) GROUP BY 1, 2),
 r AS (SELECT doc_id, count(*) dims, md5(string_agg(dim, ',' ORDER BY c DESC, dim)) ranked FROM e GROUP BY 1)
 SELECT doc_id chunk_id, CAST(coalesce(dims, 0) AS INT) dims, coalesce(ranked, md5('')) ranked, CASE WHEN dims > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END norm FROM documents LEFT JOIN r USING (doc_id)"""


def _refusals() -> str:
    phrases = ", ".join("'" + x.replace("'", "''") + "'" for x in P.REFUSALS)
    return f"""WITH p AS (SELECT unnest([{phrases}]) phrase), a AS (SELECT item_id, phrase, more, lower(phrase || substring(text, 1, more)) t FROM benchmark, p, (SELECT unnest([0, 4, 12, 20, 30, 60]) more)),
 f AS (SELECT item_id, a.phrase, more, bool_or(contains(t, p.phrase) AND length(t) <= length(p.phrase) * 16 // 10 + 8) refusal FROM a, p GROUP BY 1, 2, 3)
 SELECT item_id, phrase, CAST(more AS INT) more, refusal, CASE WHEN refusal THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END score FROM f"""


def oracle(bm: str) -> dict[str, str]:
    grid = bm + """, vq AS (SELECT vec_id query_id, embedding qv, label FROM embeddings JOIN benchmark ON item_id = vec_id),
 vs AS (SELECT query_id, vec_id chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM vq, embeddings),
 vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 12) DESC, chunk_id) "rank" FROM vs),
 w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE semantic),
 u AS (SELECT semantic, query_id, chunk_id, "rank", semantic w FROM vr, w WHERE "rank" <= 50 UNION ALL SELECT semantic, r.query_id, r.chunk_id, r."rank", 1 - semantic FROM r JOIN vq USING (query_id), w WHERE r."rank" <= 50),
 f AS (SELECT semantic, query_id, chunk_id, round(sum(w / (60 + "rank")), 9) s FROM u WHERE w > 0 GROUP BY 1, 2, 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY semantic, query_id ORDER BY s DESC, chunk_id) k FROM f),
 g AS (SELECT query_id, e.vec_id chunk_id FROM vq JOIN embeddings e USING (label)), n AS (SELECT query_id, count(*) n FROM g GROUP BY 1),
 m AS (SELECT semantic, query_id, count(*) m, sum(1 / log2(k + 1)) dcg, min(k) best FROM p JOIN g USING (query_id, chunk_id) WHERE k <= 10 GROUP BY 1, 2),
 x AS (SELECT semantic, query_id, coalesce(CAST(m AS DOUBLE) / n, 0) recall, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END hit, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) ndcg, coalesce(1.0::DOUBLE / best, 0) rr
   FROM w CROSS JOIN n LEFT JOIN m USING (semantic, query_id))
 SELECT semantic, count(*) queries, round(avg(recall), 6) recall, round(avg(hit), 6) hit, round(avg(ndcg), 6) ndcg, round(avg(rr), 6) rr FROM x GROUP BY 1"""
    return {"store_snapshot": _SNAPSHOT, "stream_ingest": _STREAM, "bm25_index": bm + 'SELECT * FROM r WHERE "rank" <= 10', "sparse_corpus": _SPARSE, "weight_grid": grid, "recursive_chunks": _recursive(),
            "refusals": _refusals(), "nfkc_texts": "SELECT doc_id, md5(text) digest FROM documents", "hash_embedding": _HASHED}
