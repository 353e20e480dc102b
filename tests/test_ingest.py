"""Ingest, store search, parsers by relation, and parts around models."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom.functions import embed as M
from ragloom.operators import retrieval as R
from ragloom.operators import signals as G
from ragloom.operators import store as D
from ragloom.plans import parts
from ragloom.plans.ask import Engine, SearchOptions
from ragloom.plans.ingest import IndexCache, Ingest, no_text, page_blocks, recognise_pages
from ragloom.sources import files as S
from ragloom.sources import office


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda *rows: f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(f"<c><v>{v}</v></c>" for v in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    return zipped({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="First" r:id="a"/><sheet name="Broken" r:id="c"/><sheet name="Second" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Type="x/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="b" Type="x/worksheet" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="c" Type="x/worksheet" Target="worksheets/none.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet((3, 4)),
        "xl/worksheets/sheet2.xml": sheet((1, 2), ("", ""), (5, 6)),
    })


def test_sheets_follow_the_workbooks_relations():
    assert office.sheet_texts(workbook()) == ["1 | 2\n5 | 6", "", "3 | 4"]
    got = list(office.parse_xlsx(workbook()))
    assert [(t, h) for t, h, _ in got] == [("1 | 2\n5 | 6", ["First", "rows 2"]), ("3 | 4", ["Second", "rows 2"])]


def deck():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda text, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    page = lambda *shapes: f"<p:sld {ns}>{''.join(shapes)}</p:sld>"
    return zipped({
        "ppt/slides/slide10.xml": page(shape("last")), "ppt/slides/slide2.xml": page(shape("first")),
        "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/notesSlide7.xml"/></Relationships>',
        "ppt/notesSlides/notesSlide7.xml": page(shape("said aloud"), shape("7", '<p:ph type="sldNum"/>'), shape("today", '<p:ph type="dt"/>')),
    })


def test_slides_and_their_notes():
    assert office.slide_texts(deck()) == ["first\n\nNotes:\nsaid aloud", "last"]
    assert [(t, p) for t, _, p in office.parse_pptx(deck())] == [("first", 1), ("said aloud", 1), ("last", 2)]


def test_notes_outside_shapes_and_of_blank_slides():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    footer = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="ftr"/></p:nvPr></p:nvSpPr><p:txBody>{par("page foot")}</p:txBody></p:sp>'
    notes = f"<p:notes {ns}><p:graphicFrame><a:tbl>{par('in a table')}</a:tbl></p:graphicFrame>{footer}<p:sp><p:txBody>{par('said')}<a:p/>{par('again')}</p:txBody></p:sp></p:notes>"
    assert office.notes_body(notes.encode()) == "in a table\n\nsaid\n\nagain"
    blank = zipped({"ppt/slides/slide1.xml": f"<p:sld {ns}/>", "ppt/notesSlides/notesSlide1.xml": notes})
    assert office.slide_texts(blank) == ["Notes:\nin a table\n\nsaid\n\nagain"]
    assert [h for _, h, _ in office.parse_pptx(blank)] == [["Slide 1", "Notes"]]


def test_markdown_fences_and_lists():
    text = "# Top\n```\n# not a heading\n```\nbody\n\n- one\n- two\n\nafter the list\n## Sub\nend"
    got = [(t, h) for t, h, _ in office.parse_markdown(text.encode())]
    assert got == [("# not a heading\nbody\none\ntwo", ["Top"]), ("after the list", ["Top"]), ("end", ["Top", "Sub"])]


def test_bad_files_cost_their_own_row(spark):
    rows = [("a.docx", "docx", b"no zip"), ("b.txt", "text", b"one\n\ntwo"), ("c.png", "image", b"x"), ("d.mp3", "audio", b"x"), ("e.txt", "text", None), ("f.xlsx", "xlsx", workbook())]
    got = office.parse_all(spark.createDataFrame(rows, "path string, kind string, content binary")).collect()
    assert {r["path"] for r in got if r["error"]} == {"a.docx", "d.mp3", "e.txt"}
    assert sorted(r["text"] for r in got if not r["error"]) == ["1 | 2\n5 | 6", "3 | 4", "one", "two"]


def test_folder_walk_filters(spark, tmp_path):
    top = tmp_path / ".hidden root"
    (top / ".git").mkdir(parents=True)
    for name in ("a.TXT", "b.md", ".c.txt", ".git/d.txt"):
        (top / name).write_text(name)
    names = lambda **o: sorted(r["path"].rpartition("/")[2] for r in S.read_files(spark, str(top), **o).select("path").collect())
    assert names(extensions=("txt",)) == ["a.TXT"] and names() == ["a.TXT", "b.md"]


def test_ingest_is_incremental_and_repeats_nothing(spark, tmp_path):
    store, cache = D.ChunkStore(spark, str(tmp_path / "store")), IndexCache(spark, str(tmp_path / "state"))
    ingest = Ingest(store, lambda t: M.bigram_embedding(t, 16), parts.DispatchChunker({"text": parts.WindowChunker(10, 0)}), parts.heading_captions, cache)
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("words of the first file")
    (folder / "b.txt").write_text("short one")
    (folder / "c.docx").write_bytes(b"no zip")
    (folder / "d.xyz").write_text("?")
    count = lambda: tuple(ingest.ingest_folder("n", str(folder)).first())
    assert count() == (4, 2, 0, 1, 1, 4)
    assert count() == (4, 0, 2, 1, 1, 0)
    (folder / "a.txt").write_text("now short!")
    assert count() == (4, 1, 1, 1, 1, 1)
    assert sorted(r["text"] for r in store.chunks("n").collect()) == ["now short!", "short one"]
    assert store.search_keywords(spark.createDataFrame([(1, "short")], "query_id long, query string"), 5, "n").count() == 2
    cache.forget(cache.get().select("path").limit(1))
    assert cache.get().count() == 1


def test_pages_of_a_stub_and_of_an_engine(spark):
    pages = spark.createDataFrame([("s", 2, b"two"), ("s", 1, b"one"), ("s", 3, b"\xff")], "source_id string, page int, content binary")
    assert page_blocks(recognise_pages(pages, no_text)).count() == 0
    got = page_blocks(recognise_pages(pages, lambda: lambda b: b.decode())).orderBy("block_idx").collect()
    assert [(r["text"], r["heading_path"], r["block_idx"]) for r in got] == [("one", ["Page 1"], 0), ("two", ["Page 2"], 1)]


def test_vectors_of_unequal_length_compare_the_shorter(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [])], "query_id string, qv array<double>")
    v = spark.createDataFrame([("x", [1.0, 0.0, 9.0]), ("y", [1.0]), ("n", None), ("w", [1.0, 1.0])], "chunk_id string, v array<float>")
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in R.vector_top_k(q, v, 4).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 1.0, ("a", "w"): 0.707107, ("a", "n"): 0.0} | {("z", k): 0.0 for k in "nwxy"}
    assert R.vector_top_k(q.limit(0), v, 4).count() == 0 and R.vector_top_k(q, v.limit(0), 4).count() == 0


@pytest.mark.parametrize("cells", [R.BLOCK_CELLS, 1])
def test_blocks_of_queries_agree(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "BLOCK_CELLS", cells)
    monkeypatch.setattr(R, "SCORED_ROWS", 2 if cells == 1 else 1024)
    q = spark.createDataFrame([(1, "red fox"), (2, "dog dog"), (3, ""), (4, "unseen")], "query_id long, query string")
    c = spark.createDataFrame([(1, "a red fox"), (2, "the dog and the fox"), (3, None), (4, "red red dog"), (5, "plain")], "chunk_id long, text string")
    got = [(r["query_id"], r["chunk_id"], r["rank"]) for r in R.bm25_top_k(q, c, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 4, 2), (2, 4, 1), (2, 2, 2)]
    near = R.caption_join(q, c.select(F.col("text").alias("caption")).where("caption is not null"), 0.3).collect()
    assert {(r["query_id"], r["caption"]) for r in near} == {(1, "a red fox")}
    assert {r["query_id"]: r["recall"] for r in G.body_recall(q, c).collect()} == {1: 1.0, 2: 2 / 3, 3: 0.0, 4: 0.0} or cells


def test_upsert_ties_go_to_the_new_row(spark):
    old = spark.createDataFrame([(1, "old", 1), (2, "old", 3)], "chunk_id long, text string, version int")
    new = spark.createDataFrame([(1, "new", 1), (2, "new", 2)], "chunk_id long, text string, version int")
    assert {r["chunk_id"]: r["text"] for r in R.upsert(old, new).collect()} == {1: "new", 2: "old"}


def test_parts_around_models(spark):
    row = spark.createDataFrame([("overview of sales", "Sales grew. Rain fell! Sales are fine.")], "q string, t string")
    value = lambda c: row.select(c.alias("x")).first()["x"]
    reply = lambda text: lambda prompt: F.lit(text)
    assert value(parts.ListRewriter(reply("1. one\n2. two\nnoise"), 1)(F.col("q"))) == ["one"]
    assert value(parts.ExpandRewriter(reply("PARAPHRASE: other words"))(F.col("q"))) == ["other words"]
    assert value(parts.passthrough(F.col("q"))) == []
    assert value(parts.ReplyJudge(reply("it is 0.8"))(F.col("q"), F.col("t"), F.col("t"))) == 0.8
    assert value(parts.overlap_judge(F.col("q"), F.col("t"), F.col("t"))) == 1.0
    assert "Sales" in value(parts.OverlapCompressor(keep=1, ratio=0.1)(F.col("q"), F.col("t")))
    assert value(parts.echo(F.lit("a\nb"))) == "[stub] b"
    chunks = spark.createDataFrame([("c", "s", 0, "about tax law", ["h"], None)], "chunk_id string, source_id string, ord int, text string, heading_path array<string>, page int")
    asked = parts.QuestionEnricher(reply("1. what tax?\n2. which law?"), 1)(chunks).first()["text"]
    assert asked == "(what tax?)\nabout tax law"
    entries = spark.createDataFrame([("tax", "c", ["levy"], ["paying"], "both")], "term string, category string, synonyms array<string>, scenarios array<string>, enrich_mode string")
    assert parts.ThesaurusEnricher(entries)(chunks).first()["text"] == "(levy, paying)\nabout tax law"
    judge = parts.IntentClassifier(reply("INTENT: compare"), parts.FifoCache(1))
    assert [judge.one(spark, q) for q in ("a question of some length", "overview of all of it", "a question of some length")] == ["compare", "summary", "compare"]
    assert list(judge.cache.held) == ["a question of some length"]


def test_answers_by_intent_from_a_store(spark, tmp_path):
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    rows = [(f"c{k}", f"s{k % 2}", k, f"text number{k} of the report", ["h"], [1.0, float(k)], "n") for k in range(6)]
    store.upsert(spark.createDataFrame(rows, "chunk_id string, source_id string, ord int, text string, heading_path array<string>, embedding array<float>, notebook_id string"))
    queries = spark.createDataFrame([(1, "summary of the report", [1.0, 0.0]), (2, "hello", [1.0, 0.0]), (3, "where is number4 in it", [1.0, 4.0])], "query_id long, query string, qv array<float>")
    meta = spark.createDataFrame([("s0", "report", 0)], "source_id string, title string, created_at_ms long")
    engine = Engine.of_store(store, "n", compress=parts.OverlapCompressor(), meta=meta)
    got = {r["query_id"]: r for r in engine.ask(queries, SearchOptions(k=2, drop_noise=False)).collect()}
    assert [got[i]["intent"] for i in (1, 2, 3)] == ["summary", "smalltalk", "lookup"]
    assert got[2]["context"] == "" and "number0" in got[1]["context"] and "number4" in got[3]["context"]


def test_source_questions(spark):
    c = spark.createDataFrame([(1, "a", "x%"), (2, "a", "y"), (3, "b", "x")], "chunk_id long, source_id string, text string")
    assert D.largest_source(c).first()["source_id"] == "a" and D.source_counts(c, 1).first()["source_id"] == "b"
    assert D.text_like(c, "x%").count() == 2
    with pytest.raises(ValueError, match="no index"):
        D.index_of(c, "other")


def test_chunks_of_whole_sources_are_those_of_their_blocks_and_shuffle_nothing(spark, tmp_path, monkeypatch):
    texts = ["one block " * 9, "first\n\n" + "second é " * 12 + "\n\nthird", "", "x"]
    files = spark.createDataFrame([(f"f{i}", "text", str(i), t.encode()) for i, t in enumerate(texts)] + [("bad", "docx", "9", b"no")], "path string, kind string, fingerprint string, content binary")
    chunker, row = parts.WindowChunker(20, 5), lambda r: (r["source_id"], r["ord"], r["chunk_id"], r["text"])
    whole = office.parse_whole(files).withColumnRenamed("path", "source_id")
    assert whole.where("error is not null").count() == 1 and whole.count() == 5
    by_block = chunker(office.parse_all(files).where("error is null").withColumnRenamed("path", "source_id"))
    for own in (chunker, parts.DispatchChunker({"text": chunker})):
        assert sorted(map(row, parts.chunk_sources(own, whole).collect())) == sorted(map(row, by_block.collect()))
    plans, upsert = [], D.ChunkStore.upsert

    def kept(self, rows, *a, **k):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString().partition("InMemoryRelation")[0])
        return upsert(self, rows, *a, **k)

    monkeypatch.setattr(D.ChunkStore, "upsert", kept)
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    Ingest(store, lambda t: M.bigram_embedding(t, 8), chunker).ingest("n", files)
    assert store.count_chunks("n") == by_block.count()
    assert not any(x in plans[0] for x in ("Window", "Join", "Sort", "Repartition"))


def test_dead_places_across_words_of_64(spark, tmp_path):
    """Deletions in two writes that share words of 64 places, ids that repeat in a write, and a compaction of one notebook."""
    store = D.ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source_id"), F.col("id").cast("int").alias("ord"), F.lit("t").alias("text"), F.lit("n").alias("notebook_id"))
    assert store.upsert(rows.unionByName(rows.where("ord >= 290")), notebook="n") == 300
    assert store.delete_by_source("n", "s3") == 43 and store.delete_by_source("n", "s0") == 43
    want = [k for k in range(300) if k % 7 not in (0, 3)]
    ords = lambda s: sorted(r["ord"] for r in s.chunks("n").select("ord").collect())
    assert ords(store) == want and ords(store.compact()) == want and store.snapshot()["dead"] == []


def test_the_state_keeps_few_files_a_write(spark, tmp_path):
    cache = IndexCache(spark, str(tmp_path / "state"))
    cache.put(spark.range(0, 800, 1, 8).select(F.col("id").cast("string").alias("path"), F.lit("s").alias("source_id"), F.lit("f").alias("fingerprint")))
    assert len(list((tmp_path / "state").glob("*.parquet"))) == 1 and cache.get().count() == 800
