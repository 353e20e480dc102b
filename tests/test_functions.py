"""Text functions, parsers and chunking on small rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunking as C
from ragloom.sources import files, office


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.bigrams, "ab a", ["ab", "ba"]),
        (T.bigrams, "a", []),
        (T.bigram_tokens, "民法典 Foo12 あ", ["民法", "法典", "foo12", "あ"]),
        (T.overlap_tokens, "民法 A Bc かな bc", ["bc", "民法"]),
        (T.caption, "(契約)\n本文", "契約"),
        (T.caption, "(条例改正)(総則)本文", "総則"),
        (T.caption, "本文", None),
        (T.defined_terms, "「甲」という。「乙」は「丙」をいう", ["甲", "丙"]),
        (T.citation_ids, "a [2] b [1][2]", [2, 1]),
        (T.is_low_content, "1 2 3 4 5", True),
        (T.is_retrieval_noise, "....................", True),
        (T.is_specific_query, "第12条とは", True),
        (T.is_specific_query, "契約とは", False),
        (T.first_unit_float, "score: 0.7 of 1", 0.7),
        (T.sentences, "A. B! C", ["A.", " B!", " C"]),
        (files.detect_kind, "a/B.PDF", "pdf"),
        (files.detect_kind, "a/b.xyz", None),
        (files.paragraphs, "a\n\n \n\nb ", ["a", "b"]),
        (files.headings, "<h1 class=x>A <b>c</b></h1><p>x</p><H2>D</H2>", ["A c", "D"]),
        (lambda c: T.windows(c, 4, 1), "abcdefgh", ["abcd", "defg", "gh"]),
        (lambda c: T.hybrid_weight(c, 0.5), "ひらがな", 0.7),
    ],
)
def test_function(spark, function, text, want):
    got = one(spark, text, function)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def _zip(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buffer.getvalue()


def test_office_and_markdown_blocks(spark):
    w, a, s = office._W[1:-1], office._A[1:-1], office._S[1:-1]
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:t>A &amp; </w:t><w:t>B</w:t></w:p><w:p/></w:document>'})
    slide = lambda t: f'<x xmlns:a="{a}"><a:p><a:t>{t}</a:t></a:p></x>'
    pptx = _zip({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/notesSlides/notesSlide2.xml": slide("note")})
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>v{i}</t></is></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, 24))
    xlsx = _zip({"xl/workbook.xml": f'<workbook xmlns="{s}"><sheet name="S"/></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}">{rows}</worksheet>'})
    data = [("d.docx", "docx", docx), ("p.pptx", "pptx", pptx), ("x.xlsx", "xlsx", xlsx), ("m.md", "markdown", b"# T\nintro\n## U\n- a\n- b\n# V\nend"), ("t.txt", "text", b"\x82\xa0\x82\xa2\x82\xa4"), ("n.pdf", "pdf", b"")]
    got = {}
    for r in office.parse_files(spark.createDataFrame(data, "path string, kind string, content binary")).orderBy("path", "block_idx").collect():
        got.setdefault(r["path"], []).append((r["text"], r["heading_path"], r["page"]))
    assert got["d.docx"] == [("A & B", [], None)]
    assert got["p.pptx"] == [("two", ["Slide 1"], 1), ("note", ["Slide 1", "Notes"], 1), ("ten", ["Slide 2"], 2)]
    assert [h for _, h, _ in got["x.xlsx"]] == [["S", "rows 2"], ["S", "rows 22"]] and got["x.xlsx"][1][0].startswith("v1 |  | 1\nv22 |")
    assert got["m.md"] == [("intro", ["T"], None), ("a\nb", ["T", "U"], None), ("end", ["V"], None)]
    assert got["t.txt"] == [("あいう", [], None)] and "n.pdf" not in got


def test_chunks_keep_all_text_and_have_stable_ids(spark):
    text = "。".join("文" * 90 for _ in range(12))
    pieces = C.recursive_split(text, C.ChunkConfig(overlap=0))
    assert "".join(pieces) == text and all(len(p) <= 600 for p in pieces)
    blocks = spark.createDataFrame([("s", 0, text, ["h"], 1), ("s", 1, "short", [], None), ("s", 2, None, [], None)], "source_id string, block_idx int, text string, heading_path array<string>, page int")
    one_, two = (sorted((r["ord"], r["chunk_id"]) for r in C.chunk_blocks(blocks.repartition(n)).collect()) for n in (1, 3))
    assert one_ == two and [o for o, _ in one_] == list(range(len(one_)))
    lines = spark.createDataFrame([("s", 0, "x"), ("s", 1, "第1章 総則"), ("s", 2, "y"), ("s", 3, "Chapter 2 Rest")], "source_id string, line_no int, line string")
    assert [r["chapter"] for r in C.chapters(lines).orderBy("line_no").collect()] == [None, "第1章 総則", "第1章 総則", "Chapter 2 Rest"]
