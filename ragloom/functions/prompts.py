"""Prompts, model outputs and query routing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and keywords that routing looks for; replace them for other languages.
# Phrases of answers that say nothing. The short and the English ones are our addition.
REFUSALS = (
    "参考資料に該当する情報は見つかりませんでした",
    "参考資料に該当する情報がありません",
    "参考資料には該当する情報がありません",
    "情報は見つかりませんでした",
    "情報なし",
    "回答できません",
    "答えられません",
) + ("わかりません", "見つかりません", "not found", "i don't know", "cannot answer")
# Keywords of summary questions. The English ones are our addition.
SUMMARY_WORDS = ("要約", "概要", "全体像", "要点", "まとめて", "について教えて") + ("summary", "summarize", "overview")
SUFFIX = " ｜ シナリオ: "
STOP = ("<end_of_turn>", "<|im_end|>")


def is_summary_query(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in SUMMARY_WORDS]), lambda w: F.contains(F.lower(text), w))


def looks_like_refusal(text: Column) -> Column:
    """A refusal phrase that makes up most of the text."""
    t = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in REFUSALS]), lambda w: F.contains(t, w) & (F.length(t) <= F.floor(F.length(w) * 1.6) + 8))


def fast_intent(query: Column) -> Column:
    """smalltalk or lookup where that is plain, else null."""
    q = F.trim(query)
    plain = ~q.rlike(r"[一-鿿0-9０-９]") & (F.length(q) <= 8)
    return F.when((q == "") | plain, "smalltalk").when(q.rlike(r"第[0-9０-９]+条|(?i:article \d)"), "lookup")


def parse_intent(reply: Column) -> Column:
    """struct(kind, topic, sources) from KEY: value lines; the last of a key counts, unknown kinds are lookup."""
    value = lambda key: F.trim(F.try_element_at(F.regexp_extract_all(reply, F.lit(rf"(?im)^\s*{key}\s*:\s*(.*)$"), F.lit(1)), F.lit(-1)))
    kind = F.lower(F.coalesce(value("intent"), F.lit("")))
    topic = F.when(~F.lower(value("topic")).isin("", "all", "n/a", "none", "なし"), value("topic"))
    sources = F.filter(F.transform(F.split(F.coalesce(value("sources"), F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.struct(F.when(kind.isin("summary", "lookup", "compare", "smalltalk"), kind).otherwise("lookup").alias("kind"), topic.alias("topic"), sources.alias("sources"))


def parse_numbered_list(reply: Column) -> Column:
    """Items of numbered or bulleted lines, quotes stripped; other lines are dropped."""
    items = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*(?:\d+[.):、：．]|[-*・])\s*(.+?)\s*$"), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"^[\"'「]+|[\"'」]+$", "")), lambda x: x != "")


def query_variants(query: Column, rewrites: Column, most: int) -> Column:
    """The query, then distinct non-blank rewrites, at most `most` of them."""
    clean = F.filter(F.transform(rewrites, lambda v: F.trim(v)), lambda v: (v != "") & (v != query))
    return F.concat(F.array(query), F.slice(F.array_distinct(clean), 1, most))


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, text), in order of rank."""
    line = F.concat(F.lit("<source id="), F.col("rank").cast("string"), F.lit(">"), F.col("text"), F.lit("</source>"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def chat_prompt(turns: Column) -> Column:
    """ChatML text of an ordered array of (role, text), open for the assistant."""
    return F.concat(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), ""), F.lit("<|im_start|>assistant\n"))


def cut_at_stop(text: Column, stops: tuple[str, ...] = STOP) -> Column:
    """The text before the earliest stop string."""
    ends = F.array(*[F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops])
    return F.when(F.array_min(ends).isNull(), text).otherwise(F.substring(text, F.lit(1), F.array_min(ends) - 1))


def held_back(text: Column, stops: tuple[str, ...] = STOP) -> Column:
    """What may be shown of a growing text: up to the earliest stop string, without an end that may begin one."""
    whole = cut_at_stop(text, stops)
    begins = sorted({s[:n] for s in stops for n in range(1, len(s))}, key=lambda b: (-len(b), b))
    held = F.coalesce(*[F.when(F.endswith(whole, F.lit(b)), len(b)) for b in begins], F.lit(0))
    return F.when(whole == text, F.substring(text, F.lit(1), F.length(text) - held)).otherwise(whole)


def gemma_prompt(turns: Column, system: Column, user: Column) -> Column:
    """Turn markers of models without a system role: the system text goes in front of the first user turn."""
    lead = F.when(F.trim(system) != "", F.concat(F.trim(system), F.lit("\n\n"))).otherwise("")
    first = F.array_position(F.transform(turns, lambda t: t["role"]), "user")
    line = lambda role, body: F.concat(F.lit("<start_of_turn>"), role, F.lit("\n"), body, F.lit("<end_of_turn>\n"))
    past = F.transform(turns, lambda t, i: line(F.when(t["role"] == "assistant", "model").otherwise("user"), F.when(i + 1 == first, F.concat(lead, t["text"])).otherwise(t["text"])))
    return F.concat(F.array_join(past, ""), line(F.lit("user"), F.when(first > 0, user).otherwise(F.concat(lead, user))), F.lit("<start_of_turn>model\n"))


def parse_expand(reply: Column) -> Column:
    """Up to 3 paraphrases (2..60 characters), 3 subquestions (4..80) and one passage (30 or more, cut at 240), in this order."""

    def tagged(tag, strip, low, high, most, number=False):
        got = F.regexp_extract_all(reply, F.lit(rf"(?m)^\s*{tag} ?:[ \t]*(.*?)\s*$"), F.lit(1))
        bare = lambda x: F.regexp_replace(x, strip, "") if strip else x
        clean = F.transform(got, lambda x: F.substring(F.trim(F.regexp_replace(bare(x), r"^[0-9.)．]+", "")) if number else bare(x), 1, high))
        return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= low)), 1, most)

    quotes = "[\"「」『』'\\-*#]+"
    edge, edge2 = f"^{quotes}|{quotes}$", f"^{quotes.replace('#', '#・')}|{quotes.replace('#', '#・')}$"
    return F.concat(tagged("PARAPHRASE", edge, 2, 60, 3), tagged("SUBQUESTION", edge2, 4, 80, 3, True), tagged("HYDE", "", 30, 240, 1))


def must_include(answer: Column, items: Column) -> Column:
    """Whether each item (an array of alternatives) has one alternative in the answer."""
    return F.forall(items, lambda any_of: F.exists(any_of, lambda s: F.contains(answer, s)))


def middle_truncate(tokens: Column, context: int, answer: int, head: int = 96, tail: int = 256) -> Column:
    """Cuts the middle of a token array to context - (answer + 64), 64 at least.

    The head keeps up to `head` tokens or a quarter, the tail up to `tail` or a half; a budget that these
    two exceed keeps the end alone.
    """
    budget, n = max(context - (answer + 64), 64), F.size(tokens)
    first = F.least(F.lit(head), F.floor(n / 4).cast("int"))
    last = F.least(F.lit(tail), F.floor(n / 2).cast("int"))
    kept = F.concat(F.slice(tokens, F.lit(1), first), F.slice(tokens, n - (budget - first) + 1, budget - first))
    return F.when(n <= budget, tokens).when(first + last < budget, kept).otherwise(F.slice(tokens, F.lit(-budget), F.lit(budget)))


def compress(sentences: Column, least: float = 0.20, keep: int = 3, ratio: float = 0.3) -> Column:
    """Text of scored sentences (array of (text, score)) at or over least, topped up to a floor by score."""
    need = F.greatest(F.lit(keep), F.ceil(F.size(sentences) * ratio).cast("int"))
    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-s["score"]).alias("r"), i.alias("i"))))
    top = F.transform(F.slice(ranked, F.lit(1), need), lambda x: x["i"])
    kept = F.filter(F.transform(sentences, lambda s, i: F.struct(s["text"].alias("text"), ((s["score"] >= least) | F.array_contains(top, i)).alias("ok"))), lambda s: s["ok"])
    return F.array_join(F.transform(kept, lambda s: s["text"]), " ")


def enrich(text: Column, terms: Column) -> Column:
    """Adds terms to a leading (...), or puts a new one in front."""
    extra = F.array_join(F.array_sort(F.array_distinct(terms)), ", ")
    return F.when(F.size(terms) == 0, text).when(text.rlike(r"^\([^)]*\)"), F.concat(F.regexp_extract(text, r"^\(([^)]*)\)", 0).substr(F.lit(1), F.instr(text, ")") - 1), F.lit(SUFFIX), extra, F.substring(text, F.instr(text, ")"), F.length(text)))).otherwise(F.concat(F.lit("("), extra, F.lit(")\n"), text))


def judge_prompt(query: Column, context: Column, answer: Column) -> Column:
    return F.concat(F.lit("How much of the answer do the sources support? Reply with one number from 0.0 to 1.0.\nSources:\n"), context, F.lit("\nQuestion: "), query, F.lit("\nAnswer: "), answer, F.lit("\nNumber:"))


def rewrite_prompt(query: Column, most: int) -> Column:
    return F.concat(F.lit(f"Write up to {most} other ways to search for this, as a numbered list and nothing else.\n"), query)


def expand_prompt(query: Column) -> Column:
    return F.concat(F.lit("Give lines PARAPHRASE: (three), SUBQUESTION: (three) and HYDE: (one short passage that would answer).\n"), query)


def intent_prompt(query: Column) -> Column:
    return F.concat(F.lit("Classify the question. Reply with three lines:\nINTENT: summary, lookup, compare or smalltalk\nTOPIC: a few words, or all\nSOURCES: names, separated by commas\n"), query)


def questions_prompt(text: Column, most: int) -> Column:
    return F.concat(F.lit(f"List up to {most} questions that this passage answers, numbered.\n"), text)


def tokenize_for_fts(tokens: Column) -> Column:
    """Tokens as a text that a full-text index splits at spaces; control characters are taken out."""
    return F.array_join(F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, r"\p{Cc}", "")), lambda t: t != ""), " ")


def risk_findings(text: Column) -> Column:
    """Findings (severity, category) in a contract clause."""
    kind = "array<struct<severity:string,category:string>>"
    return F.when(F.contains(F.lower(text), F.lit("unlimited liability")), F.array(F.struct(F.lit("high").alias("severity"), F.lit("liability").alias("category")))).otherwise(F.from_json(F.lit("[]"), kind))
