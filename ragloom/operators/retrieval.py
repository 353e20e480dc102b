"""Retrieval as joins, aggregations and windows over many queries at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T

#: A side of at most this many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: Numbers in the matrices of a block of queries (8 bytes each), and rows that are scored at once.
BLOCK_CELLS, SCORED_ROWS = 4_000_000, 1024
#: Tokens that are counted at once; a longer text stands alone.
SLICE_TOKENS = 500_000


def _width(f: Y.StructField) -> Column:
    """About the bytes that a value takes."""
    if isinstance(f.dataType, Y.StringType | Y.BinaryType):
        return F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
    if isinstance(f.dataType, Y.ArrayType):
        return F.greatest(F.size(f.name), F.lit(0)) * 16 + 24
    return F.lit(8)


def _small(df: DataFrame) -> DataFrame:
    """Hints a broadcast if rows and bytes, counted up to the bound, show that df is small."""
    few = df.limit(BROADCAST_ROWS + 1)
    got = few.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((_width(f) for f in df.schema), F.lit(0))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= BROADCAST_ROWS and got["b"] <= BROADCAST_BYTES else df


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_k(rows: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each group, ranked from 1; ties go to the least tie column."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _better(best, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of what is held (ids, scores: queries x k) and of new scores (queries x rows), ties to the least id."""
    own = np.broadcast_to(ids, scores.shape)
    if best is not None:
        own, scores = np.concatenate([best[0], own], axis=1), np.concatenate([best[1], scores], axis=1)
    order = np.lexsort((own, -scores), axis=1)[:, :k]
    return np.take_along_axis(own, order, axis=1), np.take_along_axis(scores, order, axis=1)


def block_top_k(rows: DataFrame, queries: list, query_type: Y.DataType, k: int, scorer) -> DataFrame:
    """(query_id, chunk_id, score): per task the k best rows for each of a block of queries.

    scorer() gives a task's function of an Arrow batch: scores, queries x rows, -inf where a row is no hit.
    A task holds k rows a query and SCORED_ROWS rows.
    """
    id_type, tokens = rows.schema["chunk_id"].dataType, "tokens" in rows.columns
    schema = Y.StructType([Y.StructField("query_id", query_type), Y.StructField("chunk_id", id_type), Y.StructField("score", Y.DoubleType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        score, best = scorer(), None
        for batch in token_slices(batches) if tokens else batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                best = _better(best, np.array(part.column("chunk_id").to_pylist()), score(part), k)
        if best is not None:
            q, n = np.nonzero(best[1] > -np.inf)
            ids = [queries[i] for i in q.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(query_type)), pa.array(best[0][q, n].tolist(), to_arrow_type(id_type)), pa.array(best[1][q, n])], names=["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, schema)


def _blocks(rows: list, cells: int) -> list[list]:
    """Rows in blocks of at most BLOCK_CELLS numbers at cells a row."""
    n = max(BLOCK_CELLS // max(cells, 1), 1)
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scoped(batch, scopes: list | None) -> np.ndarray | None:
    """Whether each query (row) may see each row of a batch (column); a null scope sees nothing."""
    if scopes is None:
        return None
    code = {s: n for n, s in enumerate(dict.fromkeys(scopes)) if s is not None}
    held = np.array([code.get(s, -1) for s in batch.column("scope").to_pylist()])
    asked = np.array([code.get(s, -2) for s in scopes])
    return asked[:, None] == held[None, :]


def _cosines(queries: list[list[float]], scopes: list | None):
    def scorer():
        sizes = np.array([len(q) for q in queries])
        by_size = {n: np.array([queries[i] for i in np.flatnonzero(sizes == n)], dtype=np.float64).reshape((sizes == n).sum(), n) for n in np.unique(sizes).tolist()}

        def unit(m: np.ndarray) -> np.ndarray:
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        def score(batch):
            rows = [v or [] for v in batch.column("v").to_pylist()]
            many = np.array([len(v) for v in rows])
            out = np.zeros((len(queries), len(rows)))
            for n in np.unique(many).tolist():
                at = np.flatnonzero(many == n)
                v = np.array([rows[i] for i in at], dtype=np.float64).reshape(len(at), n)
                for m, q in by_size.items():
                    both = min(n, m)
                    out[np.ix_(np.flatnonzero(sizes == m), at)] = unit(q[:, :both]) @ unit(v[:, :both]).T
            out = np.round(out, 12)  # equal vectors score the same wherever they stand
            seen = _scoped(batch, scopes)
            return out if seen is None else np.where(seen, out, -np.inf)

        return score

    return scorer


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Exact cosine top-k of queries (query_id, qv) among vectors (chunk_id, v): a stated query set in blocks.

    Each block is a matrix product per batch of vectors; a task keeps k rows a query, so the shuffle moves
    tasks x queries x k rows. Vectors of unequal length are compared over the shorter length; an empty or
    zero one scores 0. scope: a column of both; a query then sees the vectors of its scope alone.
    """
    asked = queries.select("query_id", "qv", *([F.col(scope).alias("scope")] if scope else [])).collect()
    rows = vectors.select("chunk_id", "v", *([F.col(scope).alias("scope")] if scope else []))
    kind = queries.schema["query_id"].dataType
    width = max((len(r["qv"] or ()) for r in asked), default=1)
    parts = [block_top_k(rows, [r["query_id"] for r in b], kind, k, _cosines([list(r["qv"] or ()) for r in b], [r["scope"] for r in b] if scope else None)) for b in _blocks(asked, max(width, SCORED_ROWS))]
    return top_k(_union(parts, queries.limit(0).join(vectors.limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("score"))), k)


def postings(chunks: DataFrame, tokens: Column) -> DataFrame:
    """(chunk_id, tokens): 64-bit hashes of each chunk's tokens in order, 8 bytes each.

    An index that can be written once: bm25_top_k takes chunks with this column and reads no text.
    """
    return chunks.select("*", F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens"))


def _counted(terms: np.ndarray):
    """Per task: of each query term the chunks that have it; behind them, the numbers of chunks and of tokens."""

    def run(batches):
        import pyarrow as pa

        df, n, size = np.zeros(len(terms), np.int64), 0, 0
        for batch in token_slices(batches):
            flat, doc, _ = _flat(batch)
            n, size = n + batch.num_rows, size + len(flat)
            at, doc = _numbers(flat, doc, terms)
            df += np.bincount(np.unique(doc * max(len(terms), 1) + at) % max(len(terms), 1), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms) + 2)), pa.array(np.concatenate([df, [n, size]]))], names=["i", "d"])

    return run


def token_slices(batches):
    """Slices of batches of about SLICE_TOKENS tokens, so that a task's arrays do not grow with its batches."""
    for batch in batches:
        column = batch.column("tokens")
        ends = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(ends, ends[at] + SLICE_TOKENS, side="right")) - 1, at + 1)
            yield batch.slice(at, end - at)
            at = end


def _flat(batch):
    """The token hashes of a batch, their rows, and the number of tokens of each row."""
    column = batch.column("tokens")
    many = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if column.null_count:
        many = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, many)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), many), many


def _numbers(flat: np.ndarray, doc: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens that are query terms: the term's number and the row."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    ok = terms[at] == flat
    return at[ok], doc[ok]


def _bm25(terms: np.ndarray, weight: np.ndarray, scopes: list | None, avg: float, k1: float, b: float):
    """terms: sorted hashes; weight: terms x queries, idf times the term's count in the query."""

    def scorer():
        def score(batch):
            flat, doc, many = _flat(batch)
            at, doc = _numbers(flat, doc, terms)
            cells, tf = np.unique(doc * len(terms) + at, return_counts=True)
            doc, at = cells // len(terms), cells % len(terms)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * many[doc] / max(avg, 1e-12)))
            used, column = np.unique(at, return_inverse=True)
            dense = np.zeros((batch.num_rows, len(used)))
            dense[doc, column] = part
            out = (dense @ weight[used]).T
            out = np.where(out > 0, np.round(out, 6), -np.inf)
            seen = _scoped(batch, scopes)
            return out if seen is None else np.where(seen, out, -np.inf)

        return score

    return scorer


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int, tokens=T.words, k1: float = 1.2, b: float = 0.75, scope: str | None = None) -> DataFrame:
    """BM25 top-k of queries (query_id, query) among chunks (chunk_id, text); repeated query terms count again.

    A stated query set in blocks: one pass over the chunks counts the query terms, a second scores blocks of
    queries as matrix products and keeps k rows a query and task, so no token is shuffled. chunks may be
    an index made by postings(). scope: a column of both that hits must share; the statistics stay those of
    all chunks.
    """
    index = chunks if "tokens" in chunks.columns else postings(chunks, tokens(F.col("text")))
    index = index.select("chunk_id", "tokens", *([F.col(scope).alias("scope")] if scope else []))
    asked = queries.select("query_id", F.transform(tokens(F.col("query")), lambda t: F.xxhash64(t)).alias("tokens"), *([F.col(scope).alias("scope")] if scope else [])).collect()
    kind = queries.schema["query_id"].dataType
    terms = np.unique(np.array([t for r in asked for t in r["tokens"] or ()], dtype=np.int64))
    counts = index.select("tokens").mapInArrow(_counted(terms), "i long, d long").where("d > 0").groupBy("i").agg(F.sum("d").alias("d"))
    df = np.zeros(len(terms) + 2, dtype=np.int64)
    for r in counts.collect():  # two more than the query terms
        df[r["i"]] = r["d"]
    df, n, size = df[:-2], int(df[-2]), int(df[-1])
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6) if n else np.zeros(len(terms))
    parts = []
    for block in _blocks(asked, max(len(terms), SCORED_ROWS)):
        own = np.unique(np.array([t for r in block for t in r["tokens"] or ()], dtype=np.int64))
        weight = np.zeros((len(own), len(block)))
        for q, r in enumerate(block):
            np.add.at(weight[:, q], np.searchsorted(own, np.array(r["tokens"] or (), dtype=np.int64)), 1)
        weight *= idf[np.searchsorted(terms, own)][:, None]
        parts.append(block_top_k(index, [r["query_id"] for r in block], kind, k, _bm25(own, weight, [r["scope"] for r in block] if scope else None, size / max(n, 1), k1, b)))
    return top_k(_union(parts, queries.limit(0).join(chunks.limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("score"))), k)


def rrf(rankings: DataFrame, k: int | None = None, constant: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, chunk_id, rank, weight); two rankings make a hybrid hit.

    With semantic_score and ranking_no, a hit carries the score of the last ranking that has one.
    """
    last = [F.max_by("semantic_score", F.when(F.col("semantic_score").isNotNull(), F.col("ranking_no"))).alias("semantic_score")] if "semantic_score" in rankings.columns else []
    got = rankings.where("weight > 0").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (F.lit(constant) + F.col("rank"))), 9).alias("score"), F.count("*").alias("lists"), *last)
    got = got.withColumn("hit_source", F.when(F.col("lists") >= 2, "hybrid").otherwise("single"))
    return top_k(got, k) if k else got


def cap_per_source(hits: DataFrame, most: int) -> DataFrame:
    if most <= 0:
        return hits
    w = Window.partitionBy("query_id", "source_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def neighbours(hits: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Chunks of the same source within width positions of a hit (hit_id, source_id, ord)."""
    c = chunks.select("source_id", F.col("ord").alias("near_ord"), F.col("chunk_id").alias("near_id"))
    # a band of buckets turns the range into an equi-join
    h = hits.withColumn("bucket", F.explode(F.expr(f"sequence(ord div {width * 2 + 1} - 1, ord div {width * 2 + 1} + 1)")))
    c = c.withColumn("bucket", F.expr(f"near_ord div {width * 2 + 1}"))
    return h.join(c, ["source_id", "bucket"]).where(F.col("near_ord").between(F.col("ord") - width, F.col("ord") + width)).drop("bucket")


def representatives(chunks: DataFrame, per_source: int) -> DataFrame:
    """First chunk of each top heading, at most per_source; by position if no heading is there."""
    c = chunks.withColumn("top", F.try_element_at("heading_path", F.lit(1)))
    c = c.withColumn("headed", F.max(F.col("top").isNotNull()).over(Window.partitionBy("source_id")))
    c = c.withColumn("first", F.row_number().over(Window.partitionBy("source_id", "top").orderBy("ord", "chunk_id")))
    c = c.where(~F.col("headed") | (F.col("top").isNotNull() & (F.col("first") == 1)))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("ord", "chunk_id"))).where(F.col("n") <= per_source).drop("top", "headed", "first", "n")


def caption_idf(captions: DataFrame) -> DataFrame:
    """(caption, idf): 1 for a caption that is unique, falling as it repeats."""
    n = captions.agg(F.count("*").alias("n"))
    got = captions.groupBy("caption").agg(F.count("*").alias("df")).join(F.broadcast(n))
    value = F.log((F.col("n") + 1) / (F.col("df") + 1)) / F.greatest(F.log((F.col("n") + 1) / 2), F.lit(1e-6))
    return got.select("caption", "df", F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 9).alias("idf"))


def shared_grams(queries: DataFrame, items: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """Of queries and items (key), each with grams (array of distinct strings): (query_id, key, both, nq, nc).

    A stated query set in blocks: shared grams are counted by a matrix product per batch of items, so that no
    gram is shuffled. With least, pairs of a Jaccard overlap of least or more that share a gram; without, per
    query and task the one row that shares most.
    """
    hashed = F.transform("grams", lambda g: F.xxhash64(g)).alias("tokens")
    asked = queries.select("query_id", hashed).collect()
    kind, key_type = queries.schema["query_id"].dataType, items.schema[key].dataType
    schema = Y.StructType([Y.StructField("query_id", kind), Y.StructField(key, key_type), *[Y.StructField(x, Y.LongType()) for x in ("both", "nq", "nc")]])
    every = len({t for r in asked for t in r["tokens"] or ()})

    def block(rows: list):
        ids = [r["query_id"] for r in rows]
        terms = np.unique(np.array([t for r in rows for t in r["tokens"] or ()], dtype=np.int64))
        size = np.array([len(r["tokens"] or ()) for r in rows])

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            there = np.zeros((len(terms), len(rows)), dtype=np.float32)
            for q, r in enumerate(rows):
                there[np.searchsorted(terms, np.array(r["tokens"] or (), dtype=np.int64)), q] = 1
            best = np.zeros(len(rows)), [None] * len(rows), np.zeros(len(rows))

            def batch_of(q, names, both, nc):
                return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], to_arrow_type(kind)), pa.array(names, to_arrow_type(key_type)), *[pa.array(np.asarray(x).astype(np.int64)) for x in (both, size[q], nc)]], names=schema.names)

            for batch in batches:
                for at in range(0, batch.num_rows, SCORED_ROWS):
                    part = batch.slice(at, SCORED_ROWS)
                    flat, doc, many = _flat(part)
                    term, doc = _numbers(flat, doc, terms)
                    used, column = np.unique(term, return_inverse=True)
                    dense = np.zeros((part.num_rows, len(used)), dtype=np.float32)
                    dense[doc, column] = 1
                    both = dense @ there[used]
                    names = part.column(key)
                    if least is None:
                        top = both.argmax(axis=0)
                        for q in np.flatnonzero(both[top, np.arange(len(rows))] > best[0]).tolist():
                            best[0][q], best[1][q], best[2][q] = both[top[q], q], names[int(top[q])].as_py(), many[top[q]]
                    else:
                        n, q = np.nonzero((both > 0) & (both >= (least - 1e-8) * (many[:, None] + size - both)))
                        yield batch_of(q, names.take(pa.array(n)).to_pylist(), both[n, q], many[n])
            if least is None:
                q = np.flatnonzero(best[0])
                yield batch_of(q, [best[1][i] for i in q.tolist()], best[0][q], best[2][q])

        return run

    rows = items.select(key, hashed)
    parts = [rows.mapInArrow(block(b), schema) for b in _blocks(asked, max(every, SCORED_ROWS))]
    return _union(parts, rows.sparkSession.createDataFrame([], schema))


def caption_join(queries: DataFrame, captions: DataFrame, least: float = 0.10) -> DataFrame:
    """(query_id, caption, overlap >= least) of pairs that share a bigram."""
    q = queries.select("query_id", T.bigrams(F.col("query")).alias("grams"))
    shared = shared_grams(q, captions.select("caption", T.bigrams(F.col("caption")).alias("grams")), "caption", least)
    return shared.withColumn("overlap", F.round(F.col("both") / (F.col("nq") + F.col("nc") - F.col("both")), 9)).where(F.col("overlap") >= least).select("query_id", "caption", "overlap")


def lexical_boost(hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """score *= 1 + alpha * share of query terms found in the text."""
    share = lambda terms, body: F.coalesce(F.try_divide(F.size(F.filter(terms, lambda w: F.contains(body, w))), F.size(terms)), F.lit(0.0))
    found = T.let(F.struct(T.extract_terms(F.col("query")).alias("terms"), F.lower("text").alias("body")), lambda x: share(x["terms"], x["body"]))
    return hits.withColumn("score", F.round(F.col("score") * (1 + alpha * found), 9))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Old and new rows, the highest version of each key; of equal versions the new row, then the greatest by its values."""
    old, new = old.withColumn("fresh", F.lit(0)), new.withColumn("fresh", F.lit(1))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("fresh"), F.desc(F.xxhash64(*[c for c in new.columns if c != "fresh"])))
    return old.unionByName(new).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "fresh")


def ingest_plan(files: DataFrame, state: DataFrame) -> DataFrame:
    """Per path: unchanged, changed or new, by fingerprint."""
    s = state.select("path", F.col("fingerprint").alias("old"))
    return files.join(s, "path", "left").withColumn("outcome", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("fingerprint"), "unchanged").otherwise("changed")).drop("old")
