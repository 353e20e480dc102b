"""Markdown documents, reading order of pages, and pages read while others are recognised."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ragloom.functions import media as A
from ragloom.operators import chunking as C
from ragloom.plans.ingest import overlapped, recognise_files
from ragloom.sources import markdown


@pytest.mark.parametrize(("text", "want"), [
    ("# A\n## B\n本文1\n## C\n本文2", [("本文1", ["A", "B"]), ("本文2", ["A", "C"])]),
    ("# A\n## B\ntext\n# C\nbody", [("text", ["A", "B"]), ("body", ["C"])]),
    ("just a paragraph\n\nsecond para", [("just a paragraph\nsecond para", [])]),
    ("   \n\n  ", []),
    ("# H\n本文 `code` 続き", [("本文 code 続き", ["H"])]),
    ("# T\n\n> one\n> two\nlazy\n\nafter", [("one two lazy\nafter", ["T"])]),
    ("> # Q\n> in\n> > deeper\n\nout", [("in\ndeeper\nout", ["Q"])]),
    ("- a\n  - b\n    - c\n  - d\n- e\n\nrest", [("abc", []), ("d", []), ("e", []), ("rest", [])]),
    ("- a\n\n- b\n\n  second\n\nlast", [("a\n\nb\nsecond", []), ("last", [])]),
    ("1. x\n2) y", [("x", []), ("y", [])]),
    ("- > quoted\n  > more\n- ```\n  # code\n  ```", [("quoted more\n\n# code", [])]),
    ("Title\n===\npara\n\nSub\n---\nx", [("para", ["Title"]), ("x", ["Title", "Sub"])]),
    ("a\n\n***\n\n    code  line\n      two\n\n<div>\nhtml\n</div>\n\n[ref]: http://x\nend\\\nx", [("a\ncode  line\n  two\nend x", [])]),
    ("**b** *e* _u_ a_b_c [l *i*](u) ![alt](p) <http://u.v> &amp; \\*x\\* <b>t</b> ``a ` b`` ***z***", [("b e u a_b_c l i alt http://u.v & *x* t a ` b z", [])]),
    ("~~~\n# open to the end\n- x", [("# open to the end\n- x", [])]),
    ("#no heading\n####### seven\n# \n## closed ##\ny", [("#no heading ####### seven", []), ("y", ["", "closed"])]),
])
def test_markdown_blocks(text, want):
    assert markdown.blocks(text) == want


def test_lines_of_two_columns_are_read_column_by_column(spark):
    line = lambda text, x0, y0, x1, kind="line_main", sure=0.9: (kind, x0, y0, x1, y0 + 5, sure, text)
    page = [
        line("right 1", 55, 20, 100), line("left 1", 0, 20, 45), line("Title", 0, 0, 100), line("left 2", 0, 30, 44), line("right 2", 56, 30, 99),
        line("Between", 5, 50, 95), line("right 3", 55, 60, 100), line("left 3", 1, 60, 45), line("left 3", 1, 70, 45), line("- 12 -", 45, 90, 50),
        line("figure", 0, 40, 45, "block_fig"), line("outside", 60, 40, 130), line("unsure", 0, 41, 45, sure=0.2), line("  ", 0, 42, 45), line("* * *", 0, 80, 45), line("turned", 45, 43, 40),
    ]
    schema = "p array<struct<kind: string, x0: int, y0: int, x1: int, y1: int, confidence: double, text: string>>"
    rows = spark.createDataFrame([(page,), ([],), ([line("only", 3, 1, 9)],)], schema)
    read = A.reading_order(F.col("p"), 0.5, F.lit(100), F.lit(100))
    got = [r[0] for r in rows.select(read).collect()]
    assert got[0] == ["Title", "left 1", "left 2", "right 1", "right 2", "Between", "left 3", "left 3", "* * *", "- 12 -", "right 3"] and got[1:] == [[], ["only"]]
    assert rows.select(A.clean_lines(read)).first()[0] == ["Title", "left 1", "left 2", "right 1", "right 2", "Between", "left 3", "right 3"]


def test_pages_keep_their_order_and_their_bound():
    made, done, lock, most = [], [], threading.Lock(), [0]

    def pages():
        for k in range(40):
            made.append(k)
            yield "s", k, b"%d" % k, None

    def engine(image):
        if image == b"7":
            raise ValueError("bad page")
        time.sleep(0.002 * (int(image) % 3))
        with lock:
            most[0] = max(most[0], len(made) - len(done))
        return image.decode()

    got = []
    for row in overlapped(pages(), engine, 2):
        done.append(row)
        got.append(row)
    assert [r[1] for r in got] == list(range(40)) and most[0] <= 3 * 2 + 3
    assert [r for r in got if r[3]] == [("s", 7, "", True)] and all(r[2] == str(r[1]) for r in got if not r[3])
    assert max(made.index(k) for k in range(6)) < 6  # the reader runs ahead of what was taken


def test_an_engine_and_a_reader_work_at_the_same_time():
    def pages():
        for k in range(6):
            time.sleep(0.05)
            yield "s", k, b"", None

    def engine(image):
        time.sleep(0.05)
        return "t"

    begin = time.time()
    assert len(list(overlapped(pages(), engine, 2))) == 6
    assert time.time() - begin < 6 * 0.1 * 0.9  # less than one after the other


def test_a_reader_that_fails_or_is_left_ends():
    def pages():
        yield "s", 1, b"", None
        raise OSError("the disk is gone")

    with pytest.raises(OSError, match="disk"):
        list(overlapped(pages(), lambda image: "t", 2))
    endless = (("s", k, b"", None) for k in range(10**9))
    some = overlapped(endless, lambda image: "t", 2)
    assert next(some)[1] == 0
    before = threading.active_count()
    some.close()
    assert threading.active_count() <= before


def test_files_are_rasterised_and_recognised(spark):
    def raster():
        def pages(content):
            for n, part in enumerate(content.split(b"|"), 1):
                if part == b"torn":
                    raise ValueError("torn")
                yield n, part

        return pages

    files = spark.createDataFrame([("a", b"one|two"), ("b", b"x|torn|y"), ("c", b"\xff")], "source_id string, content binary").coalesce(1)
    got = [tuple(r) for r in recognise_files(files, raster, lambda: lambda image: image.decode(), 3).collect()]
    assert got == [("a", 1, "one", False), ("a", 2, "two", False), ("b", 1, "x", False), ("b", None, "", True), ("c", 1, "", True)]
    assert recognise_files(files.limit(0), raster, lambda: lambda image: "", 3).count() == 0


@pytest.mark.parametrize("config", [C.ChunkConfig(), C.ChunkConfig(target=20, most=30, overlap=5), C.ChunkConfig(target=10, most=10, overlap=0)])
def test_recursive_pieces_are_those_of_plain_python(spark, config):
    texts = ["", "short", "。".join("文" * n for n in range(1, 40)), "para one.\n\n\n\npara two is longer than that\n\n" * 5, "？".join("abc、de fg\n" * 9 for _ in range(9)), "x" * 1500, " ".join(f"w{k}" for k in range(900)), "\\Qodd\\E !. \n" * 60, "！" * 200, "\U0001f600 " * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.recursive_pieces(F.col("t"), config).alias("p")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r["p"] == (C.recursive_split(t, config) if t else [""])
