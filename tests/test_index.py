"""Kept tables: snapshots of the store, the term and gram indexes, many patterns, sparse corpora, streams and weight grids."""

import io
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import embed as M
from ragloom.operators import bits as B
from ragloom.operators import evaluation as E
from ragloom.operators import patterns
from ragloom.operators import retrieval as R
from ragloom.operators import store as D
from ragloom.operators import term_index as X
from ragloom.operators.gram_index import GramIndex
from ragloom.operators.term_index import TermIndex
from ragloom.plans import parts
from ragloom.plans.ingest import IndexCache, Ingest
from ragloom.sources import corpora as J
from ragloom.sources.snapshots import Conflict, Snapshots
from ragloom.streaming.ingest import FILES, ingest_sink, ingest_stream, newest

ROWS = "notebook_id string, source_id string, chunk_id string, ord int, text string"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_snapshots_appear_whole_and_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.latest() == (0, {})
    s.publish(1, {"a": [1]})
    s.publish(2, {"a": [1, 2]})
    assert s.latest() == (2, {"a": [1, 2]})
    with pytest.raises(Conflict):
        s.publish(2, {"a": []})
    s.forget_before(2)
    assert s.numbers() == [2] and s.latest()[1] == {"a": [1, 2]}


def test_store_reads_prune_and_shuffle_nothing(spark, tmp_path):
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    rows = [("n" if k % 2 else "m", f"s{k % 3}", f"c{k}", k, f"text {k}") for k in range(60)]
    assert store.upsert(spark.createDataFrame(rows, ROWS).repartition(3)) == 60
    assert store.upsert(spark.createDataFrame([("n", "s1", "c1", 1, "new"), ("m", "s0", "c1", 1, "of another notebook")], ROWS)) == 2
    assert store.delete_by_source("n", "s2") == 10
    got = {(r["notebook_id"], r["chunk_id"]): r["text"] for r in store.chunks().collect()}
    want = {(n, c): t for n, s, c, _, t in rows if (n, s) != ("n", "s2")} | {("n", "c1"): "new", ("m", "c1"): "of another notebook"}
    assert got == want
    plan = plan_of(store.chunks("n"))
    assert "Window" not in plan and "SortMergeJoin" not in plan and not re.search(r"hashpartitioning|rangepartitioning", plan)
    assert "BroadcastHashJoin LeftAnti" in plan and re.search(r"PartitionFilters: \[.*commit.*notebook_id", plan)


def test_store_repeats_nulls_batches_and_old_versions(spark, tmp_path):
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("n", "s", "a", 0, "one"), ("n", "s", "a", 0, "two"), ("n", "s", None, 1, "x"), ("n", "s", None, 1, "x"), (None, "s", "b", 0, "no notebook")], ROWS)
    assert store.upsert(rows, 5, batch=("feed", 0)) == 4
    assert store.count_chunks() == 4 and store.count_chunks("") == 1
    assert store.upsert(rows, 9, batch=("feed", 0)) == 0 and store.upsert(rows, 5) == 0
    with pytest.raises(ValueError, match="not above"):
        store.upsert(rows, 4)
    gone = spark.createDataFrame([("n", "s")], "notebook_id string, source_id string")
    assert store.upsert(spark.createDataFrame([("n", "t", "c", 0, "z")], ROWS), replace=gone) == 1
    assert sorted(r["text"] for r in store.chunks().collect()) == ["no notebook", "z"]
    assert store.delete_by_notebook("n") == 1 and store.upsert(spark.createDataFrame([("n", "t", "c", 0, "back")], ROWS)) == 1
    before = sorted(r["text"] for r in store.chunks().collect())
    store.compact()
    store.vacuum()
    assert sorted(r["text"] for r in store.chunks().collect()) == before == ["back", "no notebook"]
    assert store.snapshot()["n_dead"] == 0 and len(list((tmp_path / "store" / "data").glob("commit=*"))) == 1
    assert store.upsert(rows.limit(0)) == 0 and store.count_chunks() == 2


def test_a_write_past_the_bound_of_dead_places_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "MOST_DEAD", 3)
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("n", "s", f"c{k}", k, "t") for k in range(6)], ROWS)
    store.upsert(rows)
    store.upsert(rows.withColumn("text", F.lit("u")))
    assert store.snapshot()["n_dead"] == 0 and len(store.snapshot()["commits"]) == 1
    assert [r["text"] for r in store.chunks().collect()] == ["u"] * 6


@pytest.mark.parametrize(("k", "heads", "block"), [(3, 100, 128), (3, 100, 2), (5, 2, 4)])
def test_term_index_finds_what_bm25_finds(spark, tmp_path, monkeypatch, k, heads, block):
    monkeypatch.setattr(X, "HEADS", heads)
    monkeypatch.setattr(X, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) if x < 400]
    texts = [" ".join(words[i : i + int(rng.integers(1, 40))]) for i in range(0, len(words), 12)] + [None, "", "w1 w1 w1"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "w1 w2 w300"), (2, "w1"), (3, "w7 w7 w8 w9 w10 w11"), (4, "unseen"), (5, ""), (6, None)], "query_id long, query string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    index = TermIndex.build(chunks, str(tmp_path / "index"))
    assert rows(index.top_k(asked, k)) == rows(R.bm25_top_k(asked, chunks, k))
    buckets = index.plan(asked, k)[1]
    assert len(buckets) <= 11 and "PartitionFilters: [isnotnull(bucket" in plan_of(index._read("postings", buckets)).replace("[bucket", "[isnotnull(bucket")


def test_term_index_skips_blocks_that_cannot_matter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    texts = [f"common x{k} y{k} z{k}" for k in range(200)] + ["rare common", "rare rare common", "rare pad pad pad pad pad common"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    index = TermIndex.build(chunks, str(tmp_path / "index"))
    plan, buckets = index.plan(asked, 2)
    blocks = index._read("postings", buckets).join(plan, ["bucket", "term"])
    alone = blocks.withColumn("best", F.col("weight") * F.col("most") * 2.2 / (F.col("most") + 1.2)).where("best + rest >= floor")
    assert alone.count() < blocks.count() / 10  # the blocks of "common" are not read by themselves
    assert [r["chunk_id"] for r in index.top_k(asked, 2).orderBy("rank").collect()] == [201, 200]


def test_gram_index_against_contains(spark, tmp_path):
    texts = ["Hello world", "hello", "ÜBER straße 漢字", "x", "", None, "tail ab", "ab", "hello hello WORLD", "a\0b"]
    queries = ["hello", "LO W", "ü", "ß", "漢", "漢字", "b", "ab", "x", "", "none of it", "ello\0", "d", None]
    chunks = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "chunk_id long, ord int, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    want = [(q, n, c) for q, s in enumerate(queries) if s is not None for n, c in enumerate([c for c, t in enumerate(texts) if t is not None and s.lower() in t.lower()][:3], 1)]
    index = GramIndex.build(chunks, str(tmp_path / "grams"))
    got = index.search(asked, chunks, 3)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got.collect()) == want
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in D.substring_search(asked, chunks, 3).collect()) == want
    nested = plan_of(index.candidates(asked.select("query_id", F.lower("query").alias("q"))))
    assert "CartesianProduct" not in nested and "BroadcastNestedLoopJoin" not in nested


def test_patterns_by_equal_runs(spark):
    texts = ["abcdef", "xyz", "", None, "éa", "ab" * 30, "zz abcdef"]
    terms = ["abc", "bcd", "f", "éa", "yz", "abababab", "zzz", "", None, "abcdef", "abc"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(i, x) for i, s in enumerate(texts) for x in terms if x and s and x in s[:8]}
    got = patterns.contained(t, p, "id", 8)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert patterns.contained(t, p.limit(0), "id", 8).count() == 0 and patterns.contained(t.limit(0), p, "id", 8).count() == 0


def test_sparse_corpus_takes_the_longest_entries(spark):
    entries = spark.createDataFrame([("tax", ["levy", "duty"]), ("tax law", ["tax code", "code"]), ("income", ["pay"]), ("late", ["x"]), ("law", [""])], "term string, synonyms array<string>")
    rows = [("a", "duty", "tax law of income: levy duty tax code code pay"), ("b", "", "no entry —— 。"), ("c", "late", "y" * 300 + "tax levy"), ("d", "", "tax levylevy duty。end levy 。duty")]
    got = {r["doc_id"]: r["text"] for r in J.sparse_corpus(spark.createDataFrame(rows, "doc_id string, caption string, text string"), entries).collect()}
    # three entries of a: "tax law", "income" and, of three letters, "law" before "tax"
    assert got["a"] == "tax law of income: levy duty — — —"
    assert got["b"] == "no entry — 。" and got["c"] == "y" * 300 + "ta— levy"  # its caption is an entry, its "tax" is past the probe
    assert got["d"] == "tax — 。end — 。"


def test_a_stream_ingests_each_batch_once(spark, tmp_path):
    feed = str(tmp_path / "feed")
    row = lambda path, text, n: (path, "text", text, text.encode(), n)
    for n, rows in enumerate([[row("a", "one", 0), row("b", "two", 0)], [row("a", "one more", 1)], [row("b", "two", 2), row("c", "three", 2)]]):
        spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(f"{feed}/wave-{n}")
    store, cache = D.ChunkStore(spark, str(tmp_path / "store")), IndexCache(spark, str(tmp_path / "state"))
    ingest = Ingest(store, lambda t: M.bigram_embedding(t, 8), parts.WindowChunker(40, 0), cache=cache)
    ingest_stream(spark, feed, ingest, "n", str(tmp_path / "check"), "feed", files=1).awaitTermination()
    texts = lambda: sorted(r["text"] for r in store.chunks("n").collect())
    assert texts() == ["one more", "three", "two"] and store.snapshot()["batches"]["feed"] == 2
    commits = store.snapshot()["commits"]
    sink = ingest_sink(ingest, "n", "feed")
    sink(spark.createDataFrame([row("c", "three again", 9)], FILES), 2)  # a batch that was written is not written again
    assert store.snapshot()["commits"] == commits and texts() == ["one more", "three", "two"]
    # one that died before its state was kept: the store has it, a replay completes the state
    cache.forget(cache.get().where("path = 'c'"))
    sink(spark.createDataFrame([row("c", "three", 2)], FILES), 2)
    assert cache.get().where("path = 'c'").count() == 1 and texts() == ["one more", "three", "two"]
    # of two rows of a path in one batch the newer counts
    sink(spark.createDataFrame([row("d", "older", 1), row("d", "newer", 2)], FILES), 3)
    assert texts() == ["newer", "one more", "three", "two"]


def test_weight_grid_scores_each_weight_like_a_search_of_its_own(spark):
    rng = np.random.default_rng(8)
    rows = lambda seed: spark.createDataFrame([(q, int(x), n + 1) for q in range(4) for n, x in enumerate(rng.permutation(30)[:12])], "query_id long, chunk_id long, rank int")
    vectors, keywords = rows(1), rows(2)
    golden = spark.createDataFrame([(q, int(x)) for q in range(5) for x in rng.permutation(30)[:4]], "query_id long, relevant_id long")
    got = {r["semantic"]: r for r in E.weight_grid(vectors, keywords, golden, [0.0, 0.3, 1.0, 1.7, 0.3], 5).collect()}
    assert sorted(got) == [0.0, 0.3, 1.0]
    for w, r in got.items():
        both = vectors.withColumn("weight", F.lit(w)).unionByName(keywords.withColumn("weight", F.lit(1 - w)))
        want = E.summarise(E.metrics(R.rrf(both, 5), golden, 5)).first()
        assert (r["queries"], r["recall"], r["hit"], r["ndcg"], r["rr"]) == (want["queries"], want["recall"], want["hit"], want["ndcg"], want["rr"]) and r["queries"] == 5
    assert got[0.0]["ndcg"] != got[1.0]["ndcg"]


def test_substring_search_is_one_pass_that_keeps_the_first(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdé "), size=rng.integers(0, 30))) for _ in range(400)]
    rows = [(k, None if k % 97 == 0 else int(rng.integers(50)), t) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows[::-1], "chunk_id long, ord int, text string").repartition(3)
    queries = ["a", "é ", "abc", texts[5][:12] + "ab", texts[9], "", "dcba", "abcdabcd", "\0"]
    want = set()
    for q, s in enumerate(queries):
        own = sorted((o is not None, o or 0, c) for c, o, t in rows if s in t)
        want |= {(q, c, n) for n, (_, _, c) in enumerate(own[:6], 1)}
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = D.substring_search(asked, chunks, 6)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == want
    plan = plan_of(got)
    assert "MapInArrow" in plan and "Join" not in plan


def test_token_slices_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "SLICE_TOKENS", 10)
    tokens = [[1] * n for n in (3, 4, 0, 25, 10, 1, 0, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.int64()))], names=["tokens"])
    for part in (batch, batch.slice(2)):
        got = [x.column("tokens").to_pylist() for x in R.token_slices([part])]
        assert [t for x in got for t in x] == part.column("tokens").to_pylist()
        assert all(len(x) == 1 or sum(map(len, x)) <= 10 for x in got) and len(got) > 3
    assert [x.num_rows for x in R.token_slices([batch.slice(0, 0)])] == []


def test_injected_entries_are_few_before_they_are_ranked(spark, monkeypatch):
    from ragloom.operators import boosts

    seen = []
    top_k = R.top_k
    monkeypatch.setattr(R, "top_k", lambda rows, *a: (seen.append(rows.count()), top_k(rows, *a))[1])
    captions = ["alpha beta"] * 300 + ["alpha gamma"] * 200 + ["alpha"] * 3 + ["omega"] * 50
    index = spark.createDataFrame([(k * 7919 % 1009, x) for k, x in enumerate(captions)], "chunk_id long, caption string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "zz")], "query_id long, query string")
    none = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in boosts.index_inject(none, asked, index, 5, 0.5).collect()}
    pairs = R.caption_join(asked, index.select("caption").distinct(), boosts.LEAST_OVERLAP)
    best = top_k(pairs.join(index, "caption"), 5, "overlap")
    assert got == {(r["query_id"], r["chunk_id"]): pytest.approx(0.5 * r["overlap"]) for r in best.collect()}
    assert seen == [26]


def shuffled(spark, work):
    """Bytes that the tasks of a piece of work write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    done = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (lambda s: [s.apply(k) for k in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = done()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(v for k, v in done().items() if k not in before)


def test_filters_of_keys_pass_every_key_and_few_others(spark, monkeypatch):
    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("n"))
    keys = rows.where("cast(k as long) % 5 = 0 and n = 0").unionByName(spark.createDataFrame([(None, 0)], "k string, n long"))
    want = keys.where("k is not null").count()
    got = B.maybe_in(rows, keys, ["n", "k"], "near").where("near")
    assert got.join(keys, ["k", "n"], "left_semi").count() == want == 4_000 and got.count() < want + 400 and got.columns == ["k", "n", "near"]
    assert B.maybe_in(rows, keys.limit(0), ["k"], "near").where("near").count() == 0
    monkeypatch.setattr(B, "MOST_BUCKETS", 1)  # more keys than bits: nothing is lost
    assert B.maybe_in(rows, keys, ["n", "k"], "near").where("near").join(keys, ["k", "n"], "left_semi").count() == want


def test_a_write_shuffles_what_it_replaces_whatever_the_store_holds(spark, tmp_path, monkeypatch):
    """Two stores, one eight times the other; broadcasts of the keys are out of bounds, as they are for a large batch."""
    monkeypatch.setattr(R, "BROADCAST_ROWS", 100)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = lambda n, text: spark.range(0, n, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.concat(F.lit("s"), F.expr("cast(id div 8 as string)")).alias("source_id"), F.col("id").cast("int").alias("ord"), F.lit(text).alias("text"), F.lit("n").alias("notebook_id"))
    took = []
    for n in (20_000, 160_000):
        store, batch = D.ChunkStore(spark, str(tmp_path / f"store-{n}")), rows(4_000, "new")
        store.upsert(rows(n, "old"), notebook="n")
        sources = batch.select("notebook_id", "source_id").distinct().where("source_id <> 's7'")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            took.append(shuffled(spark, lambda store=store, batch=batch, sources=sources: store.upsert(batch, replace=sources, notebook="n")))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
        assert store.snapshot()["n_dead"] == 4_000 and store.count_chunks("n") == n and store.chunks().where("text = 'new'").count() == 4_000
    assert 0 < took[1] < 1.5 * took[0], took


def test_dead_rows_are_read_as_bits_and_compacted_when_they_are_half(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "MOST_DEAD", 3)
    rows = spark.range(0, 9_000, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("source_id"), F.col("id").cast("int").alias("ord"), F.lit("t").alias("text"), F.lit("n").alias("notebook_id"))
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    store.upsert(rows)
    for k in range(3):  # 2,000 dead a write, beside each other and with live ones between
        store.upsert(rows.where(f"ord % 4 = {k} and ord < 8000").withColumn("text", F.lit(f"u{k}")), k + 1 + store.snapshot()["last"])
    snap = store.snapshot()
    assert len(snap["commits"]) == 4 and snap["n_dead"] == 6_000 and snap["n_rows"] == 15_000
    want = [(k, f"u{k % 4}" if k < 8000 and k % 4 < 3 else "t") for k in range(9_000)]
    read = lambda: sorted((r["ord"], r["text"]) for r in store.chunks("n").collect())
    assert read() == want
    store.upsert(rows.where("ord < 4000").withColumn("text", F.lit("v")))
    assert store.snapshot()["n_dead"] == 0 and len(store.snapshot()["commits"]) == 1 and store.snapshot()["n_rows"] == 9_000
    assert read() == [(k, "v" if k < 4000 else t) for k, t in want]


def test_dead_places_of_one_row_each_are_read(spark, tmp_path):
    """Lists as they were written before they held words."""
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    store.upsert(spark.createDataFrame([("n", "s", f"c{k}", k, "t") for k in range(200)], ROWS).coalesce(1))
    places = store._live(store.snapshot()).where("ord % 3 = 0").select(*D.PLACE)
    places.write.parquet(str(tmp_path / "store" / "dead" / "by=9"))
    store._publish(store.snapshot() | {"dead": [9], "n_dead": 67})
    assert sorted(r["ord"] for r in store.chunks().collect()) == [k for k in range(200) if k % 3]


def test_a_stream_shuffles_contents_only_where_paths_repeat_and_reads_old_batches_once(spark, tmp_path, monkeypatch):
    row = lambda path, text, n: (path, "text", text, text.encode(), n)
    files = [row("a", "x", 1), row("a", "y", 2), row("b", "x", 1), row(None, "x", 1), row(None, "z", 1), row("c", "x", 3)]
    got = sorted((r["path"] or "", r["fingerprint"]) for r in newest(spark.createDataFrame(files, FILES)).collect())
    assert got == [("", "z"), ("a", "y"), ("b", "x"), ("c", "x")]
    big = spark.range(0, 4_000, 1, 4).select(F.col("id").cast("string").alias("path"), F.lit("text").alias("kind"), F.lit("f").alias("fingerprint"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("content"), F.lit(1).cast("long").alias("modified"))
    assert shuffled(spark, lambda: newest(big).write.format("noop").mode("overwrite").save()) < 4_000 * 64
    store, cache, read = D.ChunkStore(spark, str(tmp_path / "store")), IndexCache(spark, str(tmp_path / "state")), []
    ingest = Ingest(store, lambda t: M.bigram_embedding(t, 8), parts.WindowChunker(40, 0), cache=cache)
    whole = Ingest.ingest
    monkeypatch.setattr(Ingest, "ingest", lambda self, notebook, files, batch=None: (read.append(batch[1]), whole(self, notebook, files, batch))[1])
    sink = ingest_sink(ingest, "n", "feed")
    first, second = (spark.createDataFrame([row("a", t, n), row(str(n), t, n)], FILES) for n, t in enumerate(("one", "two")))
    for batch, number in ((first, 0), (second, 1), (first, 0), (second, 1)):
        sink(batch, number)
    assert read == [0, 1, 1] and {r["path"]: r["fingerprint"] for r in cache.get().collect()} == {"a": "two", "0": "one", "1": "two"}
    assert sorted(r["text"] for r in store.chunks("n").collect()) == ["one", "two", "two"]


@pytest.mark.parametrize("seed", [1, 2])
def test_settled_later_a_store_holds_what_it_holds_settled_at_once(spark, tmp_path, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    schema = "notebook_id string, source_id string, chunk_id string, ord int, text string"
    pick = lambda names: names[int(rng.integers(len(names)))]
    once, later = (D.ChunkStore(spark, str(tmp_path / name)) for name in ("once", "later"))
    read = lambda s: sorted(tuple(map(str, r)) for r in s.chunks().select("notebook_id", "source_id", "chunk_id", "ord", "text").collect())
    waited = 0
    for step in range(6):
        monkeypatch.setattr(D, "LEAST_LATER", 40 if step > 3 else 1_000_000)
        rows = [(pick("mn"), pick(["s0", "s1", "s2", None]), pick([*"abcdefgh", None]), k, f"{step} {k}") for k in range(14)]
        rows = spark.createDataFrame(rows, schema).repartition(3)
        gone = [(pick(["m", "n", None]), pick(["s0", "s1", "s2", None])) for _ in range(3)] if step % 3 else None
        gone = gone and spark.createDataFrame(gone, "notebook_id string, source_id string").distinct()
        once.upsert(rows, replace=gone)
        later.upsert(rows, replace=gone, later=True, batch=("feed", step))
        assert later.upsert(rows, replace=gone, later=True, batch=("feed", step)) == 0
        waited = max(waited, len(later.snapshot()["later"]))
        assert read(later) == read(once)
        if step == 1:
            assert later.settle() and later.settle() == 0 and later.snapshot()["later"] == []
            assert read(later) == read(once)
    assert waited > 1
    assert later.delete_by_source("m", "s0") == once.delete_by_source("m", "s0") and later.snapshot()["n_later"] == 0
    later.compact()
    later.vacuum()
    assert read(later) == read(once) and later.snapshot()["n_rows"] == len(read(once))


def test_a_batch_reads_no_more_the_more_the_store_holds(spark, tmp_path):
    rows = lambda n: spark.range(0, n, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.concat(F.lit("s"), F.expr("cast(id div 8 as string)")).alias("source_id"), F.col("id").cast("int").alias("ord"), F.lit("old").alias("text"), F.lit("n").alias("notebook_id"))
    files = spark.range(0, 200, 1, 2).select(F.col("id").cast("string").alias("path"), F.lit("text").alias("kind"), F.lit("f").alias("fingerprint"), F.lit("some text").cast("binary").alias("content"), F.lit(1).cast("long").alias("modified"))
    files.write.parquet(str(tmp_path / "files"))
    jvm_doubles = lambda: spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    status = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seen = status.stageList(None, False, False, jvm_doubles(), None)
        return {(x.stageId(), x.attemptId()): x.inputRecords() for x in (seen.apply(k) for k in range(seen.size()))}

    took = []
    for n in (20_000, 160_000):
        store = D.ChunkStore(spark, str(tmp_path / f"store-{n}"))
        store.upsert(rows(n), notebook="n")
        sink = ingest_sink(Ingest(store, lambda t: M.bigram_embedding(t, 8), parts.WindowChunker(40, 0)), "n", "feed")
        before = stages()
        sink(spark.read.schema(FILES).parquet(str(tmp_path / "files")), 0)
        took.append(sum(v for k, v in stages().items() if k not in before))
        assert store.count_chunks("n") == n + 200
    assert 0 < took[1] < 1.1 * took[0], took
