"""Quotation linking: messages that quote others, joined to their originals.

A line's quote level is the number of > marks before it. Runs of lines of one level are passages;
passages are normalised (case, white space) and hashed, and so are every message's own text, its
paragraphs and its lines of LEAST words or more. A passage links to the earliest message of its own
conversation that has the hash, else to the earliest of all messages before it, conversations in order
of conv_id. Originals are reduced to one row per hash, and per hash and conversation, before the join: a
passage that everybody quotes costs one row, and the join makes no more rows than there are passages.

A passage without such a match in its own conversation is also looked for as a run of lines, of any
length: the original holds the passage's lines in consecutive places, blank lines left out. Runs are
hashed only where a line equals the first line of such a passage, and only in the numbers of lines that
passages with that first line have. The order is: own conversation by whole match, then by run; all
messages before by whole match, then by run. Parts of a line are not looked for.

The result has one row per message: its text without quotes, what it replies to (the original of its
first passage of the least level) and the root of its thread, so that (conv_id, root_turn, turn) is the
order of replies. All of it is DataFrame functions. Threads are found by pointer doubling in the shared
folder.

A null text is empty; a very long one is read whole, as one row. A message that only quotes has an empty own text. A quote without original links
to nothing. A message with a null conv_id or turn is kept, but has no place in the order: it links to nothing, nothing
links to it, and its root is itself. Repeated rows (same conv_id and turn) are kept; ties between originals go to the least
(conv_id, turn). An empty table gives an empty result. Other columns are ignored, so their names cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .native import let

LEAST = 4
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_PASSAGE = "struct<level:int,text:string>"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level, in order: array of (level, text without marks)."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.struct(quote_level(x).cast("int").alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))
    begin = F.from_json(F.lit("[]"), f"array<{_PASSAGE}>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        grown = F.struct(x["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text")).cast(_PASSAGE)
        same = F.coalesce(last["level"] == x["level"], F.lit(False))
        return F.when(same, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(a, F.array(x.cast(_PASSAGE))))

    whole = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")).cast(_PASSAGE))
    return F.when(~F.contains(text, F.lit(">")), whole).otherwise(F.aggregate(lines, begin, step))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passage_hash(text: Column) -> Column:
    return F.when(normalise(text) != "", F.sha2(normalise(text), 256))


def lines_of(text: Column) -> Column:
    """Normalised lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalise), lambda x: x != "")


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, quotes): own text, and passages of level 1 or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = messages.select("conv_id", "turn", "role", text.alias("t")).withColumn("p", passages(F.col("t")))
    own = F.array_join(F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return got.select("conv_id", "turn", "role", own.alias("own"), F.filter("p", lambda x: (x["level"] > 0) & (F.trim(x["text"]) != "")).alias("quotes"))


def _originals(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    parts = lambda t: F.concat(F.array(t), F.split(t, r"\n[ \t]*\n"), F.filter(F.split(t, "\n"), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= LEAST))
    keys = let(F.col("own"), lambda t: F.array_distinct(F.filter(F.transform(parts(t), passage_hash), lambda h: h.isNotNull())))
    every = parsed.select("conv_id", "turn", F.explode(keys).alias("hash"))
    return every.join(wanted, "hash", "left_semi")


def _run_hash(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def _runs(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the runs of own lines that equal a wanted passage's lines."""
    heads = wanted.groupBy(F.sha2(F.get("lines", F.lit(0)), 256).alias("head")).agg(F.collect_set(F.size("lines")).alias("sizes"))
    own = parsed.select("id", "conv_id", "turn", lines_of(F.col("own")).alias("lines"))
    at = own.select("id", F.size("lines").alias("m"), F.posexplode("lines").alias("i", "line")).withColumn("head", F.sha2("line", 256)).join(heads, "head")
    at = at.select("id", "i", F.filter("sizes", lambda n: n <= F.col("m") - F.col("i")).alias("sizes")).groupBy("id").agg(F.collect_list(F.struct("i", "sizes")).alias("at"))
    runs = own.join(at, "id").select("conv_id", "turn", "lines", F.explode("at").alias("a")).select("conv_id", "turn", "lines", F.col("a.i").alias("i"), F.explode("a.sizes").alias("n"))
    every = runs.select("conv_id", "turn", _run_hash(F.slice("lines", F.col("i") + 1, F.col("n"))).alias("hash"))
    return every.join(wanted.select(_run_hash(F.col("lines")).alias("hash")).distinct(), "hash", "left_semi")


def _earliest(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds near and far: the earliest originals before each quote, in its own conversation and of all."""
    near = originals.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    first = originals.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = quotes.join(near, ["hash", "conv_id"], "left").join(first, "hash", "left")
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    return found.select(*quotes.columns, here.alias("near"), F.when(F.col("first") < F.struct("conv_id", "turn"), F.col("first")).alias("far"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text, n_quotes, max_level, reply_conv, reply_turn, root_conv, root_turn."""
    parsed = c.materialise(parse(messages).withColumn("id", F.monotonically_increasing_id()), "quotes")
    quotes = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("k", "q")).select("conv_id", "turn", "k", "q.level", "q.text", passage_hash(F.col("q.text")).alias("hash"))
    base = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda x: x["level"])), F.lit(0)).alias("max_level"))
    if quotes.isEmpty():
        none = F.lit(None).cast("long")
        return base.select("*", none.alias("reply_conv"), none.alias("reply_turn"), F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"))
    originals = c.materialise(_originals(parsed, quotes.select("hash").distinct()), "originals")
    found = c.materialise(_earliest(quotes, originals), "found")
    loose = found.where("near is null").withColumn("lines", lines_of(F.col("text"))).where(F.size("lines") > 0)
    loose = c.materialise(loose.drop("text", "near", "hash").withColumn("hash", _run_hash(F.col("lines"))), "loose")
    runs = c.materialise(_runs(parsed, loose.select("lines").distinct()), "runs")
    tried = _earliest(loose.drop("lines").withColumnRenamed("far", "whole"), runs)
    at = ["conv_id", "turn", "level", "k"]
    found = found.where("near is not null").select(*at, F.col("near").alias("at")).union(tried.select(*at, F.coalesce("near", "whole", "far").alias("at"))).where("at is not null")
    reply = found.groupBy("conv_id", "turn").agg(F.min_by("at", F.struct("level", "k")).alias("reply"))
    reply = c.materialise(reply.select("conv_id", "turn", F.col("reply.conv_id").alias("up_conv"), F.col("reply.turn").alias("up_turn")), "replies")
    # pointer doubling: replies go to earlier messages, so no cycles
    up = reply
    while True:
        to = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up_conv").alias("next_conv"), F.col("up_turn").alias("next_turn"))
        hop = c.materialise(up.join(to, (up["up_conv"] == to["c"]) & (up["up_turn"] == to["t"]), "left").select("conv_id", "turn", F.coalesce("next_conv", "up_conv").alias("up_conv"), F.coalesce("next_turn", "up_turn").alias("up_turn"), F.col("next_conv").isNotNull().alias("moved")), "roots")
        up = hop.drop("moved")
        if hop.where("moved").isEmpty():
            break
    both = reply.select("conv_id", "turn", F.col("up_conv").alias("reply_conv"), F.col("up_turn").alias("reply_turn")).join(up.select("conv_id", "turn", F.col("up_conv").alias("root_conv"), F.col("up_turn").alias("root_turn")), ["conv_id", "turn"])
    return base.join(both, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("root_conv", F.coalesce("root_conv", "conv_id"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(c.table(spark, sf_dir, "conversations"))
