"""Articles, chapters and whole documents, PDF pages behind their cache, and models on small rows."""

import pytest
from pyspark.sql import functions as F

from ragloom.functions import models as M
from ragloom.functions import prompts as P
from ragloom.functions import text as T
from ragloom.operators import chunking as C
from ragloom.operators import documents as D
from ragloom.operators import evaluation as E
from ragloom.sources import pdf

BLOCKS = "source_id string, block_idx int, text string, heading_path array<string>, page int, kind string"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


def test_articles_take_the_title_above_them(spark):
    text = "前文\n（目的）\n第1条 この規約は。\n  第2条の3 本文で第1条を引く。\n(定義)\n\n第三条 終わり"
    got = one(spark, text, D.articles)
    assert [(a["label"], a["text"]) for a in got] == [(None, "前文"), ("第1条", "（目的）\n第1条 この規約は。"), ("第2条の3", "第2条の3 本文で第1条を引く。"), ("第三条", "(定義)\n\n第三条 終わり")]
    assert [text[a["start"] :][:4] for a in got] == ["前文\n（", "（目的）", "  第2", "(定義)"]
    english = "ARTICLE IV Scope\nSection 2.1 x\n1. Definitions\n1.5.7 not one\nSee Section 9"
    assert [a["label"] for a in one(spark, english, lambda t: D.articles(t, D.ENGLISH))] == ["ARTICLE IV", "Section 2.1", "1. De"]
    assert one(spark, " \n", D.articles) == [] and one(spark, None, D.articles) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("第1章 総則の規定です\nx", "第1章 総則の規定です"), ("x\n\n第2章\n\n 通則", "第2章 通則"), ("1\n2\n3\n4\n5\nChapter 7 late", None), ("Chapter 3", "Chapter 3"), ("3章 本", "3章 本"), ("3章 4", None), ("", None)],
)
def test_chapter_labels(spark, text, want):
    assert one(spark, text, D.chapter_label) == want


def test_documents_are_cut_by_articles_chapters_or_headings(spark):
    body = "この規定は契約の全体に適用されるものとする。"
    rows = [
        ("law", 0, f"第1章 総則について\n第1条 {body}", ["h"], 1, None),
        ("law", 1, f"第2条 {body}", ["h"], 2, None),
        ("law", 2, f"{body * 4}\n第3条 {body}", ["i"], 3, None),
        ("book", 0, f"Chapter 1 Start\n{body * 5}\nChapter 2 Rest\n{body * 5}", [], 1, None),
        ("book", 1, body, ["z"], 2, None),
        ("note", 0, "1. One two\n1. Two three\n1. Three four", ["T"], None, "markdown"),
        ("note", 1, "short one", ["T"], None, "markdown"),
        ("none", 0, None, None, None, None),
    ]
    got = {}
    for r in D.chunk_documents(spark.createDataFrame(rows, BLOCKS), C.ChunkConfig(least=40)).orderBy("source_id", "ord").collect():
        got.setdefault(r["source_id"], []).append((r["heading_path"], r["page"], r["text"]))
    chapter = "第1章 総則について"
    assert [(h, p) for h, p, _ in got["law"]] == [([chapter, "h"], 1), ([chapter, "h", "第1条"], 1), ([chapter, "h", "第2条"], 1), ([chapter, "i", "第3条"], 3)]
    assert [(h, p) for h, p, _ in got["book"]] == [(["Chapter 1 Start"], 1), (["Chapter 2 Rest"], 1), (["Chapter 2 Rest", "z"], 2)]
    assert got["note"] == [(["T"], None, "1. One two\n1. Two three\n1. Three four\nshort one")] and "none" not in got


def test_long_texts_fill_up_with_overlap():
    config = C.ChunkConfig(target=10, most=12, overlap=3)
    assert C.recursive_split("x" * 12, config) == ["x" * 12]
    assert C.recursive_split("abcdefgh。ijklmnop。qr", config) == ["abcdefgh。", "gh。ijklmnop。", "op。qr"]
    assert C.recursive_split("y" * 25, config) == ["y" * 10, "y" * 10, "y" * 10, "y" * 4]


def test_pdf_text_and_cached_pages(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", bytearray(b"p1\n\nq1\fp2")), ("b.pdf", bytearray(b"\xff"))], "path string, content binary")

    def strict(content):
        if b"\f" in content:
            raise ValueError("no pages here")
        return content.decode()

    got = sorted(tuple(r) for r in pdf.text_layer(files, strict, lambda b: b.decode()).collect())
    assert got == [("a.pdf", 0, "p1", 1), ("a.pdf", 1, "q1", 1), ("a.pdf", 2, "p2", 2)]
    images = spark.createDataFrame([("f", 1, bytearray(b"ab")), ("f", 2, bytearray(b"!"))], "fingerprint string, page int, image binary")
    cache = str(tmp_path / "pages")

    def engine(word):
        def read(image):
            if image == b"!":
                raise ValueError("blank")
            return [word, image.decode()]

        return lambda: read

    assert [tuple(r) for r in pdf.cached_pages(images, cache, engine("x")).collect()] == [("f", 1, ["x", "ab"])]
    assert [tuple(r) for r in pdf.cached_pages(images, cache, engine("y")).collect()] == [("f", 1, ["x", "ab"])]


def test_models_fit_hosts(spark):
    rows = M.catalogue(spark).where("base = 'gemma-4-E2B'").withColumns({"n_ctx": F.lit(8192), "kv_type": F.lit("Q8_0"), "mode": F.lit("unified"), "free_vram_mb": F.lit(None).cast("int")})
    need = 1693 + 528 + 1536
    for ram, status in ((need + 4096, "ok"), (need + 4095, "tight"), (need + 3500, "insufficient"), (100, "insufficient")):
        got = M.feasibility(rows.withColumn("total_ram_mb", F.lit(ram))).collect()[0]
        assert (got["projected_kv_mb"], got["projected_total_mb"], got["status"]) == (528, need, status)
    assert spark.range(1).select(M.cache_mb(F.lit("other"), F.lit(1024), F.lit("f16"))).collect()[0][0] == 150


def test_sentences_around_and_held_back_ends(spark):
    assert one(spark, "One. Two [1] x! Three", lambda t: T.surrounding_sentence(t, F.lit(9))) == "Two [1] x"
    assert one(spark, "One", lambda t: T.surrounding_sentence(t, F.lit(0))) == "One"
    show = lambda text: one(spark, text, lambda t: P.held_back(t, ("<end>", "</s>")))
    assert [show(x) for x in ("ab", "ab<", "ab<en", "ab<end>cd", "ab</", "")] == ["ab", "ab", "ab", "ab", "ab", ""]
    assert one(spark, "see [1] [12] [123] [1]", T.citation_ids) == [1, 12]


def test_citations_are_judged_by_their_sentences(spark):
    answers = spark.createDataFrame([(1, "Red apples grow [1]. Stars shine [1]. [2] [12] [1] [345]"), (2, "none")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "apples in autumn"), (1, 2, "x")], "query_id long, rank int, text string")
    got = {r["query_id"]: (r["total"], r["unsupported"], r["ratio"]) for r in E.verify_citations(answers, hits).collect()}
    # the last sentence has the words 12 and 345 only, which no hit has; 12 points to no hit
    assert got == {1: (5, 4, 0.8), 2: (0, 0, 0.0)}
    assert [tuple(m) for m in one(spark, "a[1]b[22]", T.citation_marks)] == [(1, 1), (22, 5)]
