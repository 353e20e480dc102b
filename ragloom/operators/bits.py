"""Sets of places and of keys as bits: a broadcast of them is small where the rows that they come from are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a row, and the bits that they make.
WORDS, SPAN = 64, 4096
#: Bits for each key, and most rows (about 600 bytes each) of a filter of keys; beyond, more rows pass it.
KEY_BITS, MOST_BUCKETS = 32, 65_536


def words(places: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by, block, word): the numbers in column `at` as bits, 64 to a word."""
    bit = F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    return places.groupBy(*by, F.expr(f"{at} div 64").alias("block")).agg(F.bit_or(bit).alias("word"))


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, words) of rows (by, block, word), of which several may be of one block: SPAN bits to a row."""
    part = F.struct(F.expr(f"cast(block % {WORDS} as int)").alias("i"), "word")
    got = rows.groupBy(*by, F.expr(f"block div {WORDS}").alias("bucket")).agg(F.collect_list(part).alias("parts"))
    every = f"transform(sequence(0, {WORDS - 1}), k -> aggregate(filter(parts, x -> x.i = k), 0L, (a, x) -> a | x.word))"
    return got.select(*by, "bucket", F.expr(every).alias("words"))


def is_set(at: str) -> Column:
    """Whether a bit (0 to SPAN - 1) of column words is set; false without words."""
    return F.expr(f"coalesce(getbit(words[cast({at} div 64 as int)], cast({at} % 64 as int)) = 1, false)")


def maybe_in(rows: DataFrame, keys: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """rows with a boolean: true wherever their columns are among the keys, and for about one in 270 of the others.

    A Bloom filter of the keys, broadcast: rows of a large table that cannot match are left out before a join, so that
    what the join shuffles grows with the keys and not with the table.
    """
    n = max(1, min(MOST_BUCKETS, -(-keys.count() * KEY_BITS // SPAN)))
    h = F.xxhash64(*columns)
    bucket, probes = F.pmod(F.shiftrightunsigned("h", 24), F.lit(n)), [f"(shiftright(h, {12 * k}) & {SPAN - 1})" for k in range(2)]
    at = F.explode(F.array(*[bucket * SPAN + F.expr(p) for p in probes])).alias("at")
    bits = packed(words(keys.select(h.alias("h")).select(at), [], "at"), [])
    marked = rows.withColumn("h", h).withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left")
    return marked.withColumn(flag, is_set(probes[0]) & is_set(probes[1])).drop("h", "bucket", "words")
