"""Filter interaction audit: what each filter removes, alone and behind the others, in every order.

Five filters, one bit of a mask each: A few words, B repeated words, C capitals, D symbols, E a text that a
smaller doc_id has as well. A to D are read off the text. E is found by partition refinement: documents are
split by code point length, then by the hashes of successive blocks of their texts, each GROWTH times the
length of the last; a class of one document is dropped in the round that leaves it alone. What survives
all blocks is compared by its full text, and the least doc_id of each text is the one that E passes.

A document's classes of all rounds are worked out in the one scan of the texts, as a chain of hashes of (the class
before, the next block), so a round moves a few numbers a text and no text. Equal chains are one row with a
count before the first round, so a group of copies of any size is one row. Texts are read a second time
only where they survive, and compared by a grouping over them that combines equal texts within each task.

Then only counts by (part, mask) are left, 32 a part at most, from which every order and step follows: a
filter removes what it fails and no filter before it fails. Over all orders a document that fails k filters is
removed by each of them in 1 of k, which gives the Shapley sums.

A null text is an empty one: no words, equal to other empty and null texts; it fails A, and E where a smaller
doc_id is empty too. A null language is the part ''. A null doc_id is larger than all others; null ids alone
have no smaller one. Repeated rows count each, and none is smaller than the other. Labels: a document is
good or toxic if any of its labels rows says so. Very long texts are read whole. An empty table gives no rows.
Further columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .native import let

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: Code points of the first block; each next block is GROWTH times as long.
BLOCK, GROWTH = 256, 4
#: Class keys (8 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def failures(own: DataFrame) -> DataFrame:
    """Adds mask, the bits of A to D, to rows with a text that is not null."""
    # a column of its own, so that the words are split once
    parts = own.withColumn("parts", F.split("text", r"[\x20\x09-\x0D]+"))
    # only the first and the last part of a split can be empty
    none = (F.get("parts", F.lit(0)) == "").cast("int") + ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    parts = parts.withColumns({"many": F.size("parts") - none, "distinct": F.size(F.array_distinct("parts")) - F.least(none, F.lit(1))}).drop("parts")
    flags = (
        F.col("many") < MIN_WORDS,
        F.col("distinct") * 100 < F.col("many") * MIN_DISTINCT,
        F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * MAX_CAPITALS,
        F.col("text").rlike(SYMBOLS),
    )
    return parts.withColumn("mask", sum((f.cast("int") * (1 << k) for k, f in enumerate(flags)), F.lit(0))).drop("many", "distinct")


def class_chain(text: Column) -> Column:
    """Classes of a text: by its length, then by each block with the class before it; its size is that of the rounds."""

    def of_length(length: Column) -> Column:
        # block k begins at BLOCK * (GROWTH**k - 1) / (GROWTH - 1); the last one that begins within the text ends it
        last = F.ceil(F.log(float(GROWTH), length * (GROWTH - 1) / F.lit(float(BLOCK)) + 1)).cast("int")
        begin = lambda k: F.least(F.lit(BLOCK) * (F.pow(F.lit(GROWTH), k) - 1) / (GROWTH - 1), length).cast("int")
        block = lambda k: F.substring(text, begin(k) + 1, begin(k + 1) - begin(k))
        rounds = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, F.array(F.xxhash64(length)), lambda a, k: F.array_append(a, F.xxhash64(F.element_at(a, -1), block(k))))

    return let(F.length(text), of_length)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def refine(chains: DataFrame) -> DataFrame:
    """Of (chain, n) the last classes, as cls, that two documents or more share after all rounds."""
    left = c.materialise(chains.withColumn("done", F.lit(False)), "chains")
    k = 0
    while not left.where("not done").isEmpty():
        own = F.get("chain", F.lit(k))
        several = left.where("not done").groupBy(own.alias("cls")).agg(F.sum("n").alias("m")).where("m > 1").select("cls")
        several = c.materialise(several, "classes")
        kept = left.where("not done").withColumn("cls", own).join(_small(several), "cls", "left_semi").drop("cls")
        kept = kept.withColumn("done", F.size("chain") <= k + 1)
        left = c.materialise(kept.unionByName(left.where("done").select(*kept.columns)), "chains")
        k += 1
    return left.select(F.element_at("chain", -1).alias("cls")).distinct()


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = c.materialise(failures(own).select("doc_id", "part", "mask", class_chain(F.col("text")).alias("chain")), "masks")
    shared = c.materialise(refine(read.groupBy("chain").agg(F.count("*").alias("n"))), "shared")
    # the full texts of what survives; equal ones become one row within each task
    keys = _small(shared)
    full = own.select("doc_id", "text", F.element_at(class_chain(F.col("text")), -1).alias("cls")).join(keys, "cls", "left_semi")
    least = full.groupBy("cls", "text").agg(F.min("doc_id").alias("first"))
    least = c.materialise(least.select("cls", "first").distinct().withColumn("least", F.lit(True)), "least")
    each = read.withColumn("cls", F.element_at("chain", -1)).join(keys.withColumn("shared", F.lit(True)), "cls", "left")
    each = each.join(least.withColumnRenamed("cls", "of"), (F.col("cls") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    copy = F.col("shared").isNotNull() & F.col("least").isNull()
    return each.select("doc_id", "part", F.when(copy, F.col("mask") + (1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))


def mask_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic)."""
    marks = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(k) == 1).cast("int")), F.lit(0)).alias(v) for k, v in (("quality", "good"), ("toxic", "bad"))])
    marks = marks.where("good + bad > 0")
    sums = [F.count("*").alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).alias(v) for k, v in (("good", "good"), ("bad", "toxic"))]]
    return found.select("doc_id", "part", "mask").join(marks, "doc_id", "left").groupBy("part", "mask").agg(*sums)


def interactions(counts: DataFrame) -> DataFrame:
    """Every order and step of each part, from its mask counts."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append({"filter_order": "".join(order), "step": k + 1, "before": before, "bit": bit})
            before |= bit
    columns = ("n", "good", "toxic")
    sums = lambda x: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(x))), F.lit(0)) for m in range(1 << len(FILTERS))]).alias(x)
    wide = counts.groupBy("part").agg(*[sums(x) for x in columns])
    step = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")).alias("s")
    each = wide.select("part", *columns, step).select("part", "s.*", *columns)
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    bit, before = F.col("bit"), F.col("before")

    def total(x: str, when) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(when(m), F.get(F.col(x), m)).otherwise(0))

    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    orders = len(steps) // len(FILTERS)
    share = F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(bit) != 0, F.get("n", m) * F.floor(F.lit(orders) / F.bit_count(m)).cast("long")).otherwise(0))
    return each.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masks(c.table(spark, sf_dir, "documents"))
    return interactions(mask_counts(found, c.table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < w.doc_id OR (w.doc_id IS NULL AND first IS NOT NULL) THEN 16 ELSE 0 END AS mask,
    coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, 1 AS step, 0 AS before, b1 AS bit FROM o UNION ALL SELECT filter_order, 2, b1, b2 FROM o
  UNION ALL SELECT filter_order, 3, b1 + b2, b3 FROM o UNION ALL SELECT filter_order, 4, b1 + b2 + b3, b4 FROM o
  UNION ALL SELECT filter_order, 5, b1 + b2 + b3 + b4, b5 FROM o),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
