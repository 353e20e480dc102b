"""What surrounds recognisers of pages and speech: boxes, lines, segments, samples. Recognisers themselves plug in."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

_CJK = r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]"


def union_box(boxes: DataFrame, by: str) -> DataFrame:
    """The box around all boxes (x0, y0, x1, y1) of a key that are not all zero; null if none is."""
    real = (F.col("x0") != 0) | (F.col("y0") != 0) | (F.col("x1") != 0) | (F.col("y1") != 0)
    part = lambda f, c: f(F.when(real, F.col(c))).alias(c)
    return boxes.groupBy(by).agg(part(F.min, "x0"), part(F.min, "y0"), part(F.max, "x1"), part(F.max, "y1"))


def join_lines(lines: Column) -> Column:
    """Ordered lines as a paragraph: nothing between two CJK characters that run on, a line end elsewhere."""
    empty = F.lit("")

    def step(a, x):
        runs_on = a.rlike(_CJK + "$") & x.rlike("^" + _CJK)
        return F.when(a == "", x).when(runs_on, F.concat(a, x)).otherwise(F.concat(a, F.lit("\n"), x))

    return F.aggregate(lines, empty, step)


def page_lines(blocks: Column, least: float) -> Column:
    """Of (kind, x0, y0, x1, y1, confidence, text): lines inside the page, confident and not blank, top to bottom."""
    inside = lambda b: b["kind"].startswith("line_") & (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    kept = F.filter(blocks, lambda b: inside(b) & (b["confidence"] >= least) & (F.trim(b["text"]) != ""))
    ordered = F.array_sort(F.transform(kept, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["text"].alias("text"))))
    return F.transform(ordered, lambda b: b["text"])


#: A line this share of the page's text wide runs over all columns: it ends the columns above it.
FULL_WIDTH = 0.6
#: Lines that are decoration: marks alone, or a page number among marks.
DECORATION = r"^[\s\p{Punct}—–―・…─━│|]*(?:\d{1,4}[\s\p{Punct}—–―・…─━│|]*)?$"


def reading_order(blocks: Column, least: float, width: Column | None = None, height: Column | None = None) -> Column:
    """Texts of lines (kind, x0, y0, x1, y1, confidence, text) as they are read: by band, column, then from the top.

    Kept are lines inside the page, confident and not blank. Columns are what gaps leave between the lines' spans
    over x; lines of FULL_WIDTH of the text's width lie across them, and each begins a band of columns of its own. Each
    line is compared with the full lines and the columns of its page.
    """
    inside = lambda b: b["kind"].startswith("line_") & (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    fits = lambda b: (F.lit(True) if width is None else b["x1"] <= width) & (F.lit(True) if height is None else b["y1"] <= height)
    kept = F.filter(blocks, lambda b: inside(b) & fits(b) & (b["confidence"] >= least) & (F.trim(b["text"]) != ""))

    def placed(lines: Column) -> Column:
        return T.let(F.array_max(F.transform(lines, lambda b: b["x1"])) - F.array_min(F.transform(lines, lambda b: b["x0"])), lambda span: of_span(lines, span))

    def of_span(lines: Column, span: Column) -> Column:
        full = lambda b: (b["x1"] - b["x0"]) >= span * FULL_WIDTH
        narrow = F.array_sort(F.transform(F.filter(lines, lambda b: ~full(b)), lambda b: F.struct(b["x0"].alias("x0"), b["x1"].alias("x1"))))
        begin = F.struct(F.lit(None).cast("double").alias("edge"), F.array().cast("array<double>").alias("starts"))

        def step(a: Column, b: Column) -> Column:
            gap = a["edge"].isNull() | (b["x0"] > a["edge"])
            starts = F.when(gap, F.array_append(a["starts"], b["x0"].cast("double"))).otherwise(a["starts"])
            return F.struct(F.greatest(a["edge"], b["x1"].cast("double")).alias("edge"), starts.alias("starts"))

        def order(x: Column) -> Column:
            starts, wide = x["starts"], x["wide"]

            def key(b: Column) -> Column:
                # a full line comes before the columns of the band that it begins
                band = F.size(F.filter(wide, lambda y: y < b["y0"])) * 2 + F.when(full(b), 1).otherwise(0)
                column = F.when(full(b), 0).otherwise(F.size(F.filter(starts, lambda x: x <= b["x0"])))
                return F.struct(band.alias("band"), column.alias("column"), b["y0"].alias("y0"), b["x0"].alias("x0"), b["text"].alias("text"))

            return F.transform(F.array_sort(F.transform(lines, key)), lambda k: k["text"])

        tops = F.transform(F.filter(lines, full), lambda b: b["y0"])
        return T.let(F.struct(F.aggregate(narrow, begin, step, lambda a: a["starts"]).alias("starts"), tops.alias("wide")), order)

    return F.when(F.size(blocks) == 0, F.array().cast("array<string>")).otherwise(T.let(kept, placed))


def clean_lines(lines: Column) -> Column:
    """Lines without decoration, and a line that repeats the one before it once."""
    own = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.rlike(DECORATION))
    return T.let(own, lambda x: F.filter(x, lambda t, i: (i == 0) | (t != F.coalesce(F.get(x, i - 1), F.lit("")))))


def segments_as_blocks(transcripts: DataFrame) -> DataFrame:
    """(path, block_idx, text, heading_path) of transcripts (path, segments array of text); blank segments go."""
    name = F.element_at(F.split("path", "/"), -1)
    got = transcripts.select("path", F.posexplode("segments").alias("block_idx", "text")).where(F.trim("text") != "")
    return got.select("path", "block_idx", "text", F.array(F.lit("Audio"), name).alias("heading_path"))


def transcript_body(segments: Column) -> Column:
    return F.array_join(segments, "\n")


def mono(samples: Column, channels: int) -> Column:
    """Interleaved 16-bit samples as means of frames in -1..1."""
    n = F.floor(F.size(samples) / channels).cast("int")
    frames = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.aggregate(F.slice(samples, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, v: a + v.cast("double")) / (channels * 32767.0))
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(frames)


def resample(samples: Column, rate: int, to: int = 16_000) -> Column:
    """Linear interpolation to another rate; floor(n * to / rate) samples."""
    ratio, n = to / rate, F.size(samples)
    m = F.floor(n * F.lit(ratio)).cast("int")

    def at(i):
        x = i / F.lit(ratio)
        k = F.least(F.floor(x).cast("int"), n - 1)
        low, high = F.get(samples, k).cast("double"), F.get(samples, F.least(k + 1, n - 1)).cast("double")
        return low + (high - low) * (x - k)

    return F.when(m < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), at))


def wav_duration(content: bytes) -> int:
    """Milliseconds, from the header."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes() * 1000 // w.getframerate()


def recognise(files: DataFrame, engine: Callable[[], Callable[[bytes], Iterable[str]]]) -> DataFrame:
    """(path, segments) by an engine that each task makes once; a file that fails has no segments."""

    def run(batches):
        import pyarrow as pa

        own = engine()
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append(list(own(content)))
                except Exception:  # noqa: BLE001 - one bad file must not end the job; its row says so
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["path", "segments"])

    return files.select("path", "content").mapInArrow(run, "path string, segments array<string>")
