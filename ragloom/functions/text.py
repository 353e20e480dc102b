"""Scalar and array functions over text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from_sentences = r"(?<=[。.!?\n])"


#: Overlapping pairs of characters: one is consumed, two are seen. Linear in the text's length.
PAIRS = r"(?s)(?=(..))."


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though body uses it inside a lambda or several times."""
    return F.transform(F.array(value), body)[0]


def bigrams(text: Column) -> Column:
    """Distinct adjacent pairs of characters, white space dropped."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(PAIRS), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Share of a found in b; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def novelty(body: Column, caption: Column) -> Column:
    return F.when(F.size(body) == 0, 0.0).otherwise(F.size(F.array_except(body, caption)) / F.size(body))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigram_tokens(text: Column) -> Column:
    """Overlapping pairs of CJK runs (single characters kept), other runs as lower-case words."""
    cjk = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"
    runs = F.regexp_extract_all(text, F.lit(rf"{cjk}+|(?:(?!{cjk})[\p{{L}}\p{{N}}])+"), F.lit(0))
    pairs = lambda r: F.regexp_extract_all(r, F.lit(PAIRS), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(~r.rlike(cjk), F.array(F.lower(r))).when(F.length(r) == 1, F.array(r)).otherwise(pairs(r))))


def overlap_tokens(text: Column) -> Column:
    """Sorted distinct runs of two or more Han or alphanumeric characters."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{IsHan}]{2,}|[A-Za-z0-9０-９]{2,}"), F.lit(0)), F.lower)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, from_sentences), lambda s: F.trim(s) != "")


def content_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}]", ""))


def is_low_content(text: Column) -> Column:
    return (F.length(F.trim(text)) < 4) | (content_chars(text) < 4)


def is_retrieval_noise(text: Column) -> Column:
    t = F.trim(text)
    leaders = F.length(F.regexp_replace(t, "[^.・…─━·]", ""))
    toc = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x).rlike(r"^[0-9][^.]{0,6}\."))) >= 2
    return (t == "") | (content_chars(t) < 25) | ((F.length(t) < 60) & (leaders * 10 >= F.length(t) * 3)) | toc


def is_specific_query(text: Column) -> Column:
    """Article numbers, quotations, addresses, code, or long questions."""
    quoted = text.rlike(r"\"[^\"]{2,}\"|「[^」]{2,}」")
    address = text.rlike(r"https?://|[\w.+-]+@[\w-]+\.\w")
    return text.rlike(r"第[0-9０-９一二三四五六七八九十百]+条|(?i:article) \d") | quoted | address | has_code(text) | (F.length(text) >= 50)


def has_code(text: Column) -> Column:
    """Runs of 4 capitals or underscores, two code symbols, snake_case of 4 characters, CamelCase of 5."""
    snake = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{4})[A-Za-z0-9]*_"
    camel = r"(?<![A-Za-z])(?=[A-Za-z]{5})[A-Z][A-Za-z]+?[A-Z]"
    return text.rlike(rf"[A-Z_]{{4}}|{snake}|{camel}") | (F.regexp_count(text, F.lit("[(){};=%<>]")) >= 2)


def article_lead(text: Column) -> Column:
    """Up to 80 characters of the first sentence behind a leading article number; a revision note before it is skipped."""
    t = F.regexp_replace(text, r"^\s+", "")
    note = F.regexp_extract(t, r"^\(([^)]*)\)", 1)
    t = F.when((note != "") & is_revision_note(note), F.regexp_replace(t, r"^\([^)]*\)\s*", "")).otherwise(t)
    numeral = "0-9一二三四五六七八九十百千〇零"
    lead = F.regexp_extract(t, rf"^第[{numeral}]+条(?:の[0-9一二三四五六七八九十]+)?[\s　]*([^。\n]{{1,80}})", 1)
    lead = F.regexp_replace(lead, r"\s+$", "")
    return F.when(lead != "", lead)


def caption_or_lead(text: Column) -> Column:
    return F.coalesce(caption(text), article_lead(text))


def extract_terms(text: Column) -> Column:
    """Sorted distinct ASCII words of two or more characters, and pairs of Japanese ones with particles taken out first."""
    ascii_words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: w.rlike("[A-Za-z0-9]"))
    bare = F.regexp_replace(text, r"[\sはがをにでとのへや、。?？]", "")
    pairs = F.regexp_extract_all(bare, F.lit(r"(?=([一-龥ぁ-んァ-ヶ]{2}))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(F.transform(ascii_words, F.lower), pairs)))


def embedding_text(heading_path: Column, text: Column) -> Column:
    return F.when(F.size(heading_path) > 0, F.concat(F.array_join(heading_path, " / "), F.lit("\n"), text)).otherwise(text)


def fts_text(heading_path: Column, text: Column) -> Column:
    return F.concat(F.array_join(heading_path, " "), F.lit("\n"), text)


def inject_caption(heading_path: Column, text: Column) -> Column:
    """Puts (last heading) in front, unless there is none, it has parentheses or the text starts with one."""
    last = F.trim(F.coalesce(F.try_element_at(heading_path, F.lit(-1)), F.lit("")))
    skip = (last == "") | last.rlike(r"[()（）]") | F.ltrim(text).startswith("(")
    return F.when(skip, text).otherwise(F.concat(F.lit("("), last, F.lit(")\n"), text))


def chunk_summary(text: Column) -> Column:
    return F.substring(F.split(text, "\n")[0], 1, 80)


def compressor_sentences(text: Column) -> Column:
    """Trimmed sentences; the ASCII period does not end one."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?\n])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """Array of (start, end, text) in bytes, end exclusive, separators at the left sentence."""
    begin = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,text:string>>")

    def step(a, s):
        at = F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))
        return F.concat(a, F.array(F.struct(at.alias("start"), (at + F.octet_length(s)).alias("end"), s.alias("text"))))

    return F.filter(F.aggregate(F.split(text, from_sentences), begin, step), lambda x: F.trim(x["text"]) != "")


def is_revision_note(text: Column) -> Column:
    return F.contains(text, F.lit("条例")) & text.rlike("改正|全改|追加|削除|旧")


def caption(text: Column) -> Column:
    """The leading (...) of a text; the second one if the first is a revision note."""
    first = F.regexp_extract(text, r"^\(([^)]*)\)", 1)
    second = F.regexp_extract(text, r"^\([^)]*\)\s*\(([^)]*)\)", 1)
    pick = F.when(is_revision_note(first), second).otherwise(first)
    return F.when((pick == "") | is_revision_note(pick), F.lit(None).cast("string")).otherwise(pick)


def defined_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"「([^」]+)」(?=という|をいう)"), F.lit(1)))


def citation_ids(text: Column) -> Column:
    """Distinct numbers of [n] markers of one or two digits, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))


def running(lengths: Column) -> Column:
    """0 and the running sums of an array of integers."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def citation_marks(text: Column) -> Column:
    """Array of (n, at) of every [n] marker of one or two digits; at counts characters from 0."""
    pattern = r"\[\d{1,2}\]"

    def place(marks: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = running(F.transform(marks, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return let(ends, lambda e: F.transform(marks, lambda m, i: F.struct(F.regexp_extract(m, r"\d+", 0).cast("int").alias("n"), (F.get(e, i + 1) - F.length(m)).alias("at"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def surrounding_sentence(text: Column, at: Column) -> Column:
    """The sentence around a character position (from 0), without its separators."""
    before, behind = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    both = F.concat(F.regexp_extract(before, r"[^。.!?\n]*$", 0), F.regexp_extract(behind, r"^[^。.!?\n]*", 0))
    return F.regexp_replace(both, r"^\s+|\s+$", "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Sliding character windows; the last partial one is kept. Windows of the overlap alone are cut off."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.slice(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), last + 1))


def hybrid_weight(query: Column, base: float) -> Column:
    """Leans towards vectors for kana, towards keywords for kanji and alphanumerics; clamped to 0.05..0.95."""
    n = F.regexp_count(query, F.lit(r"\S"))
    share = lambda p: F.coalesce(F.try_divide(F.regexp_count(query, F.lit(p)), n), F.lit(0.0))
    kana, other = share(r"[぀-ヿ]"), share(r"[一-鿿A-Za-z0-9０-９]")
    moved = base + F.greatest(F.least(kana - other, F.lit(1.0)), F.lit(-1.0)) * 0.2
    return F.when(F.length(query) < 4, F.lit(base)).otherwise(F.greatest(F.least(moved, F.lit(0.95)), F.lit(0.05)))


def first_unit_float(text: Column) -> Column:
    found = F.regexp_extract(text, r"\d*\.\d+|\d+\.", 0)
    return F.when(found == "", 0.0).otherwise(F.greatest(F.least(F.try_to_number(found, F.lit("999999999D999999999")).cast("double"), F.lit(1.0)), F.lit(0.0)))
