"""The store, sources, boosts, signals and the search and answer plans on small rows."""

import io
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import contracts as K
from ragloom.functions import embed as M
from ragloom.functions import media as A
from ragloom.functions import prompts as P
from ragloom.functions import text as T
from ragloom.operators import boosts as B
from ragloom.operators import evaluation as E
from ragloom.operators import signals as G
from ragloom.operators import store as D
from ragloom.plans.ask import Engine, SearchOptions
from ragloom.sources import corpora as J


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.article_lead, "第三条の二 法律は、かく定める。次", "法律は、かく定める"),
        (T.article_lead, "(条例改正)第1条 あいう\nえ", "あいう"),
        (T.article_lead, "条文", None),
        (T.extract_terms, "Foo_bar 民法の契約 a b1 __", ["b1", "foo_bar", "契約", "民法", "法契"]),
        (T.bigrams, "a😀b", ["a😀", "😀b"]),
        (T.bigrams, "", []),
        (T.has_code, "call SnakeX now", True),
        (T.has_code, "a_bc", True),
        (T.has_code, "a_b plain words", False),
        (T.compressor_sentences, "ab. cd! あ。い", ["ab. cd!", "あ。", "い"]),
        (lambda c: F.transform(T.sentence_spans(c), lambda x: x["end"]), "ab. あ。", [3, 10]),
        (lambda c: T.inject_caption(F.array(F.lit("h")), c), "body", "(h)\nbody"),
        (lambda c: T.inject_caption(F.array(F.lit("h")), c), "(x)body", "(x)body"),
        (lambda c: T.embedding_text(F.array(F.lit("a"), F.lit("b")), c), "t", "a / b\nt"),
        (lambda c: T.windows(c, 4, 2), "abcdef", ["abcd", "cdef"]),
        (P.parse_expand, "PARAPHRASE: \"abc\"\nPARAPHRASE: abc\nSUBQUESTION: 1. what is it\nother", ["abc", "what is it"]),
        (lambda c: P.must_include(c, F.array(F.array(F.lit("x"), F.lit("b")), F.array(F.lit("a")))), "ab", True),
        (M.nfkc, "ＡＢ①", "AB1"),
        (lambda c: A.join_lines(F.array(c, F.lit("書。"), F.lit("次"), F.lit("x"))), "契約", "契約書。\n次\nx"),
    ],
)
def test_functions(spark, function, text, want):
    assert one(spark, text, function) == want


def test_embeddings_match_plain_python(spark):
    got = one(spark, "abca", lambda c: M.bigram_embedding(c, 16))
    want = np.zeros(16)
    for g in ("ab", "bc", "ca"):
        want[M.fnv1a(g.encode()) % 16] += 1
    assert np.allclose(got, want / math.sqrt((want**2).sum()), atol=1e-6)
    h = M.fnv1a(b"ab")
    turned = ((h << 7) | (h >> 57)) & (1 << 32) - 1
    assert one(spark, "ab", lambda c: M.hash_embedding(c, 2))[1] == pytest.approx((turned - (turned >> 31 << 32)) / (2**31 - 1), abs=1e-6)
    table = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert one(spark, "x", lambda c: M.pooled_embedding(F.array(F.lit(0), F.lit(1), F.lit(9)), table)) == pytest.approx([0.7071, 0.7071], abs=1e-3)


def test_store_keeps_the_latest_and_forgets_the_deleted(spark, tmp_path):
    store = D.ChunkStore(spark, str(tmp_path / "chunks"))
    assert store.count_chunks() == 0
    rows = [("n", "s1", "a", 0, "x"), ("n", "s1", "b", 1, "y"), ("n", "s2", "c", 0, "z"), ("m", "s3", "d", 0, "w")]
    schema = "notebook_id string, source_id string, chunk_id string, ord int, text string"
    store.upsert(spark.createDataFrame(rows, schema), 1)
    store.upsert(spark.createDataFrame([("n", "s1", "a", 0, "new")], schema), 2)
    store.upsert(spark.createDataFrame([("n", "s1", "a", 0, "new")], schema), 2)  # a replay
    assert store.count_chunks() == 4 and store.count_sources("n") == 2
    assert store.chunks("n").where("chunk_id = 'a'").collect()[0]["text"] == "new"
    assert store.delete_by_source("n", "s1", 3) == 2 and store.count_chunks("n") == 1
    store.upsert(spark.createDataFrame([("n", "s1", "b", 1, "again")], schema), 4)
    assert store.count_chunks("n") == 2 and store.delete_by_notebook("m", 5) == 1
    assert store.compact(str(tmp_path / "small")).count_chunks() == 2


def test_corpora_and_thesaurus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": "1", "text": "t", "caption": "cap"}, {"doc_id": "2", "parent_id": "p", "title": "T", "text": "u"}]))
    corpus = J.read_corpus(spark, str(tmp_path / "c.json"))
    got = {r["chunk_id"]: r for r in J.corpus_chunks(corpus, captioned=True).collect()}
    assert got["1"]["text"] == "(cap)\nt" and got["1"]["heading_path"] == ["1"]
    assert got["2"]["source_id"] == "p" and got["2"]["heading_path"] == ["T"] and got["2"]["text"] == "u"
    (tmp_path / "g.json").write_text(json.dumps({"name": "g", "items": [{"query": "q", "relevant": ["p", "1"], "tags": []}]}))
    golden = J.read_golden(spark, str(tmp_path / "g.json")).select("query_id", F.explode("relevant").alias("relevant_id"))
    assert G.golden_granularity(golden.where("relevant_id = 'p'"), corpus).collect()[0][0] == "parent"
    assert G.golden_granularity(golden, corpus).collect()[0][0] == "doc"
    text = '{"ab":{"category":"c","synonyms":["s"],"scenarios":["z"],"enrich_mode":"literal_only"},"__c":"head"}'
    entries = spark.createDataFrame([(text,)], "t string").select(F.inline(J.thesaurus(F.col("t"))))
    chunks = spark.createDataFrame([(1, "xabx"), (2, "none")], "chunk_id long, text string")
    assert [tuple(r) for r in J.thesaurus_terms(chunks, entries).collect()] == [(1, ["s"])]
    xml = '<Article Num="1"><ArticleCaption>(目的)</ArticleCaption><ArticleTitle>第一条</ArticleTitle><Sentence>この法律</Sentence></Article><Article><ArticleTitle>x</ArticleTitle></Article>'
    assert [tuple(r) for r in one(spark, xml, J.law_articles)] == [("第一条", "目的", "この法律")]


def test_media(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 2.0, 3.0, 4.0, 5.0), (1, 1.0, 4.0, 3.0, 9.0), (2, 0.0, 0.0, 0.0, 0.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r) for r in A.union_box(box, "k").collect() if r["x0"] is not None) == [(1, 1.0, 3.0, 4.0, 9.0)]
    assert one(spark, "", lambda c: A.resample(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), 8000, 16_000)) == [0.0, 0.5, 1.0, 0.5, 0.0, 0.0]
    assert one(spark, "", lambda c: A.mono(F.array(F.lit(32767), F.lit(0)), 2)) == [0.5]
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    assert A.wav_duration(data.getvalue()) == 500
    files = spark.createDataFrame([("a/x.wav", bytearray(data.getvalue())), ("a/bad.wav", bytearray(b"no"))], "path string, content binary")
    got = A.segments_as_blocks(A.recognise(files, lambda: lambda b: [f"{A.wav_duration(b)} ms", " "])).collect()
    assert [(r["path"], r["text"], r["heading_path"]) for r in got] == [("a/x.wav", "500 ms", ["Audio", "x.wav"])]


def test_boosts_and_contracts(spark):
    hits = spark.createDataFrame([(1, 1, "s", "(abc)\nx", ["zz"], "abc", 1.0), (1, 2, "t", "「abc」という。", ["abc"], "abc", 0.5)], "query_id long, chunk_id long, source_id string, text string, heading_path array<string>, query string, score double")
    assert [r["score"] for r in B.caption_boost(hits, 0.2).orderBy("chunk_id").collect()] == [1.2, 0.7]
    assert [r["score"] for r in B.heading_boost(hits, 0.2).orderBy("chunk_id").collect()] == [1.0, 0.7]
    meta = spark.createDataFrame([("s", "The ABC", 0)], "source_id string, title string, created_at_ms long")
    assert [r["score"] for r in B.source_meta_boost(hits, meta, F.lit(10)).orderBy("chunk_id").collect()] == [1.15, 0.5]
    slices = spark.createDataFrame([("d", 1, "liability", "Unlimited Liability."), ("d", 2, "term", " ")], "doc_id string, clause_no int, category string, text string")
    good, bad = K.not_empty(slices)
    assert good.count() == bad.count() == 1 and K.risks(slices).count() == 1
    assert K.revisions(slices).collect()[0]["suggestion"] == "liability capped at the fees paid."
    template = spark.createDataFrame([("liability",), ("warranty",)], "category string")
    assert [tuple(r) for r in K.missing_clauses(template, slices).collect()] == [("d", "warranty")]


def test_citation_spans_and_sweep(spark):
    answers = spark.createDataFrame([(1, "red apples grow [1].")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "blue sky. red apples here.")], "query_id long, rank int, text string")
    assert E.citation_spans(answers, hits).collect()[0]["sentence"].strip() == "red apples here."
    runs = spark.createDataFrame([("a", 1, 7, 1), ("b", 1, 8, 1), ("b", 1, 7, 2)], "run_id string, query_id long, chunk_id long, rank int")
    golden = spark.createDataFrame([(1, 7)], "query_id long, relevant_id long")
    assert {r["run_id"]: r["rr"] for r in E.weight_sweep(runs, golden, 5).collect()} == {"a": 1.0, "b": 0.5}


def test_search_and_ask(spark):
    text = "the contract of sale binds both the seller and the buyer"
    chunks = spark.createDataFrame([(k, f"s{k % 3}", k, f"(topic {k})\n{text} number{k}", ["h"]) for k in range(12)], "chunk_id long, source_id string, ord long, text string, heading_path array<string>")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(12)], "chunk_id long, v array<float>")
    queries = spark.createDataFrame([(1, "number7 contract", [1.0, 7.0])], "query_id long, query string, qv array<float>")
    engine = Engine(chunks, vectors, rewrite=lambda q: F.array(F.concat(q, F.lit(" sale"))), rerank=lambda q, t: F.when(F.contains(t, F.lit("number3")), 1.0).otherwise(0.0))
    assert engine.search(queries).orderBy("rank").collect()[0]["chunk_id"] == 7
    full = SearchOptions(k=5, adjust_weight=True, most_variants=2, caption_alpha=0.1, caption_idf=True, heading_alpha=0.1, inject=3, per_source=2)
    got = engine.search(queries, full).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0]["chunk_id"] == 7
    assert max(sum(r["source_id"] == s for r in got) for s in ("s0", "s1", "s2")) <= 2
    ranked = engine.search(queries, SearchOptions(k=3, rerank_weight=0.9)).orderBy("rank").collect()
    assert ranked[0]["chunk_id"] == 3
    answer = engine.ask(queries, SearchOptions(k=3)).collect()[0]
    assert answer["answer"] == "[stub] number7 contract" and answer["total"] == 0 and answer["context"].startswith("<source id=1>")
    assert engine.auto(SearchOptions()).per_source == 1


def test_metrics_by_labels_are_those_of_the_pairs_and_make_none(spark):
    asked = spark.createDataFrame([(q, q % 3) for q in range(40)] + [(1, 2), (2, 0), (50, None)], "query_id long, label int")
    items = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(7, 2), (8, 0), (9, None), (7, 1)], "relevant_id long, label int")
    pairs = asked.join(items, "label").select("query_id", "relevant_id")
    hits = spark.createDataFrame([(q, (q * 7 + r * r) % 60, r) for q in [*range(35), 50, 51] for r in range(1, 8)], "query_id long, chunk_id long, rank int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(E.metrics(hits, (asked, items), 5)) == rows(E.metrics(hits, pairs, 5))
    runs = hits.select(F.explode(F.array(F.lit(3), F.lit(7))).alias("run_id"), "*").where("rank <= run_id")
    assert rows(E.weight_sweep(runs, (asked, items), 5)) == rows(E.weight_sweep(runs, pairs, 5))
    v = hits.where("rank % 2 = 0")
    assert rows(E.weight_grid(v, hits, (asked, items), [0.0, 0.5], 5)) == rows(E.weight_grid(v, hits, pairs, [0.0, 0.5], 5))


def test_bigram_embedding_counts_pairs_of_any_characters(spark):
    texts = ["", "a", "é", "\0x", "漢字漢字漢", "a b", "x\U0001f600\U0001f600", None, "the cat the hat" * 50]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", M.bigram_embedding(F.col("t"), 32).alias("v")).orderBy("i").collect()]
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(32)
        for g in [t[i : i + 2] for i in range(len(t) - 1)] if len(t or "") > 1 else list(t or ""):
            want[M.fnv1a(g.encode()) % 32] += 1
        assert v == pytest.approx((want / (np.linalg.norm(want) or 1)).tolist(), abs=1e-6)


def test_bigrams_of_many_texts_are_those_of_each(monkeypatch):
    import numpy as np

    from ragloom.functions import embed

    def alone(t, dim):
        v = np.zeros(dim)
        for k in range(max(len(t) - 1, 0)):
            v[embed.fnv1a(t[k : k + 2].encode()) % dim] += 1
        if len(t) == 1:
            v[embed.fnv1a(t.encode()) % dim] += 1
        return v

    texts = ["", "a", "ab", "", "", "aab aab", "漢", "漢字漢字", "😀x", "\0\0\0", " ", "é" * 9, "z", ""]
    for most_pairs in (4_000_000, 0):
        monkeypatch.setattr(embed, "MOST_PAIRS", most_pairs)
        assert embed.bigram_counts(texts, 8, {}).tolist() == [alone(t, 8).tolist() for t in texts]
    assert embed.bigram_counts([], 8, {}).shape == (0, 8) and embed.bigram_counts(["", ""], 8, {}).sum() == 0
