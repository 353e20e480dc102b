"""Queries over whole documents, models and growing texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import media as A
from .functions import models as M
from .functions import prompts as P
from .functions import text as T
from .operators import documents as D
from .sources import office

STOPS = ("ende", "the end", "er.")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _turns(s, d, head: str, tail: str = ""):
    text = F.concat(F.lit(head), F.col("turn").cast("string"), F.lit(f"{tail}\n"), F.col("text"))
    return _t(s, d, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("block_idx"), text.alias("text"), F.array("role").alias("heading_path"), F.col("turn").cast("int").alias("page"))


def q_articles(s, d):
    got = D.article_segments(_turns(s, d, "Section "))
    return got.select("source_id", "block_idx", F.array_join("heading_path", "/").alias("heading"), F.md5("text").alias("text_md5"), "page")


def q_articles_ja(s, d):
    got = D.article_segments(_turns(s, d, "第", "条"))
    return got.select("source_id", "block_idx", F.array_join("heading_path", "/").alias("heading"), F.md5("text").alias("text_md5"), "page")


def q_chapters(s, d):
    got = D.with_chapters(D.split_at_chapters(_turns(s, d, "Chapter ")))
    return got.select("source_id", "block_idx", "chapter", "page")


def q_feasible(s, d):
    models = M.catalogue(s).withColumn("n", F.substring("base", -3, 3))
    hosts = _t(s, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(m[6][-3:]) for m in M.CATALOGUE]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("n"), F.round(F.col("c_acctbal") * 4).cast("int").alias("total_ram_mb"))
    rows = hosts.join(F.broadcast(models), "n").withColumns({"n_ctx": F.lit(8192), "kv_type": F.when(F.col("c_custkey") % 8 < 4, "q8_0").otherwise("f16"), "mode": F.when(F.col("c_custkey") % 3 == 0, "gpu").otherwise("cpu"), "free_vram_mb": F.lit(6000)})
    return M.feasibility(rows).select("c_custkey", "projected_kv_mb", "projected_total_mb", "available_mb", "status")


def q_held(s, d):
    return _t(s, d, "conversations").select("conv_id", "turn", F.md5(P.held_back(F.col("text"), STOPS)).alias("shown"))


def q_around(s, d):
    return _t(s, d, "benchmark").select("item_id", F.md5(T.surrounding_sentence(F.col("text"), F.floor(F.length("text") / 2).cast("int"))).alias("sentence"))


#: Words of an item, of letters alone, and a Markdown document made of them.
_WORDS = r"regexp_extract_all(text, '[A-Za-z]+', 0)"
_MARKDOWN = "concat('# T', item_id, '\n\n> ', w[0], ' **', w[1], '**\n> ', w[2], '\n', w[3], '\n\n- ', w[4], '\n  - ', w[5], '\n  - [', w[6], '](u)\n- ', w[7], '\n\n1. ', w[8], '\n\n2. ', w[9], '\n\nSub\n---\n```\n# ', w[10], '\n```\n> # Q\n> > `', w[11], '` ', w[12])"


def q_markdown(s, d):
    """Quotes, nested and loose lists, code and headings of documents made of the items' words."""
    made = _t(s, d, "benchmark").select("item_id", F.expr(_WORDS).alias("w")).where("size(w) >= 13").select(F.col("item_id").cast("string").alias("path"), F.lit("markdown").alias("kind"), F.expr(_MARKDOWN).cast("binary").alias("content"))
    return office.parse_files(made).select("path", "block_idx", "text", F.array_join("heading_path", "/").alias("heading"))


def q_columns(s, d):
    """Reading order of pages in two columns under full lines, whose lines come in the order of a scan, and their clean-up."""
    words = F.split("text", r"\s+")
    side = lambda i: i % 2
    row = lambda i: F.floor(i / 2) * 2 + F.when(i % 20 == 0, 0).otherwise(1)
    full = lambda i: i % 20 == 0
    box = lambda w, i: F.struct(F.lit("line_main").alias("kind"), F.when(full(i) | (side(i) == 0), 0).otherwise(55).alias("x0"), row(i).alias("y0"), F.when(full(i) | (side(i) == 1), 100).otherwise(45).alias("x1"), (row(i) + 1).alias("y1"), F.when(i % 13 == 7, 0.1).otherwise(0.9).alias("confidence"), F.when(i % 17 == 5, F.concat(F.lit("- "), i.cast("string"), F.lit(" -"))).otherwise(w).alias("text"))
    lines = A.reading_order(F.transform(words, box), 0.5, F.lit(100), F.lit(100_000))
    return _t(s, d, "benchmark").select("item_id", F.array_join(lines, "\n").alias("t"), F.array_join(A.clean_lines(lines), "\n").alias("c")).select("item_id", F.md5("t").alias("ordered"), F.md5("c").alias("cleaned"))


QUERIES = {"markdown_blocks": q_markdown, "page_columns": q_columns, "article_segments": q_articles, "article_segments_ja": q_articles_ja, "chapter_marks": q_chapters, "model_feasibility": q_feasible, "held_back": q_held, "surrounding_sentence": q_around}

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

def _articles(label: str, line: str) -> str:
    return f"SELECT CAST(conv_id AS VARCHAR) source_id, CAST(turn - lo AS INT) block_idx, was || '/' || {label} heading, md5({_TRIM.format(f'({line} || chr(10) || text)')}) text_md5, CAST(turn_was AS INT) page FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) n, lag(role, 1, role) OVER (PARTITION BY conv_id ORDER BY turn) was, lag(turn, 1, turn) OVER (PARTITION BY conv_id ORDER BY turn) turn_was, min(turn) OVER (PARTITION BY conv_id) lo FROM conversations) WHERE n >= 3"


_COLUMNS = """WITH w AS (SELECT item_id, unnest(a) t, unnest(range(len(a))) i FROM (SELECT item_id, regexp_split_to_array(text, '\\s+') a FROM benchmark)),
 b AS (SELECT item_id, i, i % 20 = 0 f, CASE WHEN i % 17 = 5 THEN '- ' || i || ' -' ELSE t END t FROM w WHERE i % 13 <> 7 AND trim(CASE WHEN i % 17 = 5 THEN '-' ELSE t END, ' ') <> ''),
 n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) band FROM b),
 o AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY band, CASE WHEN f THEN 0 ELSE 1 END, i % 2, i) n FROM n),
 c AS (SELECT item_id, n, trim(t, ' ') t FROM o WHERE NOT regexp_matches(trim(t, ' '), '^[\\s!-/:-@\\[-`{-~—–―・…─━│|]*(?:\\d{1,4}[\\s!-/:-@\\[-`{-~—–―・…─━│|]*)?$')),
 k AS (SELECT item_id, n, t, lag(t) OVER (PARTITION BY item_id ORDER BY n) was FROM c),
 x AS (SELECT item_id, md5(string_agg(t, chr(10) ORDER BY n)) ordered FROM o GROUP BY 1), y AS (SELECT item_id, md5(string_agg(t, chr(10) ORDER BY n)) cleaned FROM k WHERE was IS NULL OR was <> t GROUP BY 1)
 SELECT item_id, coalesce(ordered, md5('')) ordered, coalesce(cleaned, md5('')) cleaned FROM benchmark LEFT JOIN x USING (item_id) LEFT JOIN y USING (item_id)"""

ORACLE = {
    "markdown_blocks": """WITH i AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') w FROM benchmark WHERE len(regexp_extract_all(text, '[A-Za-z]+')) >= 13),
 b AS (SELECT item_id, unnest([0, 1, 2, 3, 4]) b, w FROM i)
 SELECT CAST(item_id AS VARCHAR) path, CAST(b AS INT) block_idx, CASE b WHEN 0 THEN w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4] || chr(10) || w[5] || w[6] || chr(10) || w[7] WHEN 1 THEN w[8] WHEN 2 THEN w[9] || chr(10) || chr(10) || w[10] WHEN 3 THEN '# ' || w[11] ELSE w[12] || ' ' || w[13] END text,
  CASE WHEN b < 3 THEN 'T' || item_id WHEN b = 3 THEN 'T' || item_id || '/Sub' ELSE 'Q' END heading FROM b""",
    "page_columns": _COLUMNS,
    "article_segments_ja": _articles("'第' || turn || '条'", "'第' || turn || '条'"),
    "article_segments": _articles("'Section ' || turn", "'Section ' || turn"),
    "chapter_marks": "SELECT CAST(conv_id AS VARCHAR) source_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) block_idx, 'Chapter ' || turn chapter, CAST(turn AS INT) page FROM conversations",
    "model_feasibility": """WITH m AS (SELECT * FROM (VALUES (0, 1693, 120), (1, 2715, 140), (2, 12797, 200), (3, 14725, 130)) t(i, size_mb, kib)),
 r AS (SELECT c_custkey, size_mb, CAST(round(kib * 8192 * CASE WHEN c_custkey % 8 < 4 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END / 1024) AS INT) kv, greatest(CAST(round(c_acctbal * 4) AS INT) - 4096, 0) + CASE WHEN c_custkey % 3 = 0 THEN 6000 ELSE 0 END av FROM customer JOIN m ON i = c_custkey % 4)
 SELECT c_custkey, kv projected_kv_mb, size_mb + kv + 1536 projected_total_mb, av available_mb, CASE WHEN size_mb + kv + 1536 <= av THEN 'ok' WHEN size_mb + kv + 1536 <= av * 1.10::DOUBLE THEN 'tight' ELSE 'insufficient' END status FROM r""",
    "held_back": """WITH c AS (SELECT conv_id, turn, text, list_min(list_filter([strpos(text, 'ende'), strpos(text, 'the end'), strpos(text, 'er.')], lambda p: p > 0)) p FROM conversations),
 h AS (SELECT *, list_max(list_transform(['e', 'en', 'end', 't', 'th', 'the', 'the ', 'the e', 'the en', 'er'], lambda b: CASE WHEN ends_with(text, b) THEN length(b) ELSE 0 END)) n FROM c)
 SELECT conv_id, turn, md5(CASE WHEN p IS NULL THEN substring(text, 1, length(text) - n) ELSE substring(text, 1, p - 1) END) shown FROM h""",
    "surrounding_sentence": f"SELECT item_id, md5({_TRIM.format('''(regexp_extract(substring(text, 1, length(text) // 2), '[^。.!?\\n]*$') || regexp_extract(substring(text, length(text) // 2 + 1), '^[^。.!?\\n]*'))''')}) sentence FROM benchmark",
}
