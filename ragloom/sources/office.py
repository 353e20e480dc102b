"""Office and Markdown files as blocks, parsed inside tasks with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markdown

BLOCKS = "path string, block_idx int, text string, heading_path array<string>, page int"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEET_ROWS = 20

Block = tuple[str, list[str], int | None]


def parse_text(content: bytes) -> Iterator[Block]:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("shift_jis", errors="replace")
    for part in text.split("\n\n"):
        if part.strip():
            yield part.strip(), [], None


def parse_markdown(content: bytes) -> Iterator[Block]:
    """Blocks under a stack of headings, markup left out; see the module markdown."""
    yield from ((text, path, None) for text, path in markdown.blocks(content.decode("utf-8", errors="replace")))


def parse_docx(content: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if text:
            yield text, [], None


def _cells(z: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[list[str]]:
    for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
        out: list[str] = []
        for cell in row.iter(f"{_S}c"):
            letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            out += [""] * (max(at, len(out) + 1) - len(out))
            value = cell.find(f"{_S}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if value is None else value.text or ""
            out[(at or len(out)) - 1] = shared[int(text)] if cell.get("t") == "s" and text else text
        yield out


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (type, file) of the relations of a part of the package."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    path = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], path(r.get("Target", ""))) for r in ElementTree.fromstring(z.read(rels))}


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the workbook's order, by relation, else by number."""
    found = _targets(z, "xl/workbook.xml")
    sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))
    by_id = lambda s: found.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None), (None, None))[1]
    return [(s.get("name"), by_id(s) or f"xl/worksheets/sheet{i}.xml") for i, s in enumerate(sheets, 1)]


def sheet_texts(content: bytes) -> list[str]:
    """One text per sheet in order; a sheet that cannot be read is empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        for _, sheet in _sheets(z):
            try:
                out.append("\n".join(" | ".join(r) for r in _cells(z, sheet, shared) if any(x.strip() for x in r)))
            except (KeyError, ValueError, IndexError, ElementTree.ParseError):
                out.append("")
    return out


def parse_xlsx(content: bytes) -> Iterator[Block]:
    """Blocks of SHEET_ROWS rows under the sheet's name, each led by the header row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for title, sheet in _sheets(z):
            rows = [" | ".join(r) for r in _cells(z, sheet, shared)] if sheet in names else []
            if not rows:
                continue
            for i in range(max(1, -(-(len(rows) - 1) // SHEET_ROWS))):
                body = [r for r in rows[1 + i * SHEET_ROWS : 1 + (i + 1) * SHEET_ROWS] if r.replace("|", "").strip()]
                if body or len(rows) == 1:
                    yield "\n".join([rows[0], *body]), [title, f"rows {i * SHEET_ROWS + 2}"], None


#: Placeholders of notes that are not text: fixed values.
FURNITURE = ("sldNum", "dt", "ftr")


def _drawn_text(xml: bytes, furniture: tuple[str, ...] = ()) -> str:
    """The text of a drawing, a line per paragraph, but for that of shapes whose placeholder is furniture."""
    out: list[str] = []

    def walk(node, seen: bool) -> None:
        if node.tag == f"{_P}sp":
            seen = not any(p.get("type") in furniture for p in node.iter(f"{_P}ph"))
        if node.tag == f"{_A}t" and seen:
            out.append(node.text or "")
        for child in node:
            walk(child, seen)
        if node.tag == f"{_A}p":
            out.append("\n")

    walk(ElementTree.fromstring(xml), True)
    return "".join(out).strip()


def notes_body(xml: bytes) -> str:
    """Text of a notes page, in shapes or outside them, without slide numbers, dates and footers."""
    return _drawn_text(xml, FURNITURE)


def _slides(content: bytes) -> Iterator[tuple[str, str]]:
    """(text, notes) of the slides in order of their numbers; notes by relation, else by number."""
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        for name in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            related = _targets(z, name)
            notes = next((t for kind, t in related.values() if kind == "notesSlide"), None if related else f"ppt/notesSlides/notesSlide{number(name)}.xml")
            yield _drawn_text(z.read(name)), notes_body(z.read(notes)) if notes in names else ""


def parse_pptx(content: bytes) -> Iterator[Block]:
    """A block per slide in order of its number, and one for its notes."""
    for page, (text, notes) in enumerate(_slides(content), 1):
        if text:
            yield text, [f"Slide {page}"], page
        if notes:
            yield notes, [f"Slide {page}", "Notes"], page


def slide_texts(content: bytes) -> list[str]:
    """One text per slide, its notes behind it; of a blank slide the notes alone."""
    return ["\n\n".join(x for x in (text, f"Notes:\n{notes}" if notes else "") if x) for text, notes in _slides(content)]


PARSERS = {"text": parse_text, "markdown": parse_markdown, "docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx}


def parse_one(kind: str | None, content: bytes | None) -> tuple[list[Block], str | None]:
    """Blocks, or why there are none: images have no text of their own, audio needs a recogniser."""
    if kind == "image":
        return [], None
    if kind not in PARSERS:
        return [], f"no parser for {kind}"
    if content is None:
        return [], "no content"
    try:
        return list(PARSERS[kind](content)), None
    except Exception as e:  # noqa: BLE001 - a damaged file costs its own row, not the job
        return [], f"{type(e).__name__}: {e}"[:200]


WHOLE = "path string, kind string, blocks array<struct<block_idx int, text string, heading_path array<string>, page int>>, error string"


#: Characters of parsed files that a task hands on at once.
CHARS_OUT = 1_000_000


def parse_whole(files: DataFrame) -> DataFrame:
    """A row for each (path, kind, content) row: its blocks in order, or an error where it cannot be parsed."""

    def run(batches):
        import pyarrow as pa

        block = pa.struct([("block_idx", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("page", pa.int32())])
        kinds = (pa.string(), pa.string(), pa.list_(block), pa.string())
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "kind", "blocks", "error"])
        for batch in batches:
            rows, held = [], 0
            for path, kind, content in zip(*(batch.column(k).to_pylist() for k in ("path", "kind", "content")), strict=True):
                blocks, error = parse_one(kind, content)
                rows.append((path, kind, [{"block_idx": i, "text": text, "heading_path": heading, "page": page} for i, (text, heading, page) in enumerate(blocks)], error))
                held += 100 + sum(len(text) for text, _, _ in blocks)
                if held >= CHARS_OUT:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return files.select("path", "kind", "content").mapInArrow(run, WHOLE)


def parse_all(files: DataFrame) -> DataFrame:
    """Blocks of (path, kind, content) rows with their kind, and for a file that cannot be parsed one row with an error."""
    rows = parse_whole(files).where("error is not null or size(blocks) > 0")
    return rows.select("path", "kind", F.explode_outer("blocks").alias("b"), "error").select("path", "kind", "b.*", "error")


def parse_files(files: DataFrame) -> DataFrame:
    """Blocks of (path, kind, content) rows; files that cannot be parsed give none."""
    return parse_all(files).where("error is null").drop("kind", "error")
