"""Mixing sources to target weights by capped water-filling.

A source of size s may be repeated at most `epochs` times, so its target stops at epochs * s. What a
capped source cannot take is reshared by weight among the others until none is above its cap. That
ends at target = min(cap, level * weight) for one water level, which sorting the sources by
cap / weight and running sums give in closed form, whatever the number of sources.

A document is then taken floor(target / size) whole times, and once more if the fractional part picks
it. The pick is systematic: the documents of a source stand in order of size (ties by a seeded hash),
and document number j goes once more where floor((j + 1) * f + u) > floor(j * f + u). Neighbours in
this order have nearly equal sizes, so the words taken miss the target by about one document at most;
of PHASES values of u a source uses the one that comes nearest.

Ranks come from counts by (source, size) and by (source, size, salt), so no task holds a whole source. The
sources themselves, however many, are sorted by range partitions: running sums within each, and the sums of
the partitions before it.

Null texts have size 0; documents of size 0 are never taken. Very long texts count whole. A null source is a source of its own,
ordered last. Equal rows are told apart by doc_id; an empty table gives an empty result. Other columns
of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
SALTS = 256
#: Tables with a row for each source are broadcast up to this number of sources, else joined by shuffle.
BROADCAST_SOURCES = 100_000
PHASES = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), F.lit(0).cast("long"))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums, in order and each row included: sums maps new names to columns."""
    parts = c.materialise(df.repartitionByRange(*order).withColumn("ragloom_part", F.spark_partition_id()), "range")
    upto = Window.partitionBy("ragloom_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.groupBy("ragloom_part").agg(*[F.sum(v).alias(f"ragloom_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("ragloom_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("ragloom_part", *[F.coalesce(F.sum(f"ragloom_{k}").over(earlier), F.lit(0)).alias(f"ragloom_{k}") for k in sums])
    out = parts.withColumns({k: F.sum(v).over(upto) for k, v in sums.items()}).join(F.broadcast(totals), "ragloom_part")
    return out.withColumns({k: F.col(k) + F.col(f"ragloom_{k}") for k in sums}).select(*df.columns, *sums)


def water_fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Adds target to sources (source_key, source_size, weight): all of them share the sum of sizes."""
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = c.materialise(running(s, ["ratio", "source_key"], {"caps": "cap", "weights": "weight"}), "caps")
    total, every = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).collect()[0]
    # the level if this source is the first that is not capped; right for the first whose ratio reaches it
    level = F.try_divide(F.lit(float(total)) - (F.col("caps") - F.col("cap")), F.lit(every) - F.col("weights") + F.col("weight"))
    first = s.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("ratio", "source_key", "level"))["level"]).collect()[0][0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))
    return s.drop("caps", "weights").withColumn("target", target)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, copies, taken), one row per document.

    weights repeat over the sources in code point order, null last.
    """
    sized = c.materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    # a key that is never null, and sorts null last
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    sized = sized.withColumn("source_key", key)
    totals = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    placed = running(totals.withColumn("one", F.lit(1)), ["source_key"], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    targets = water_fill(placed.withColumn("weight", weight).drop("one", "place"), epochs).select("source_key", "source_size", "weight", "target")
    targets = c.materialise(targets, "targets")

    salt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)).alias("salt")
    salted = sized.where("size > 0").withColumn("salt", salt)
    cells = c.materialise(salted.groupBy("source_key", "size", "salt").agg(F.count("*").alias("m")), "cells")
    by_size = cells.groupBy("source_key", "size").agg(F.sum("m").alias("m"))
    upto = Window.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_size = by_size.withColumn("r0", F.sum("m").over(upto) - F.col("m")).select("source_key", "size", "r0")
    within = Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cell = cells.withColumn("r1", F.sum("m").over(within) - F.col("m")).drop("m").join(at_size, ["source_key", "size"])
    number = F.row_number().over(Window.partitionBy("source_key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    ranked = salted.withColumn("r2", number - 1).join(at_cell, ["source_key", "size", "salt"]).withColumn("j", F.col("r0") + F.col("r1") + F.col("r2"))
    ranked = ranked.select("doc_id", "source", "size", "source_key", "j").unionByName(sized.where("size = 0").select("doc_id", "source", "size", "source_key", F.lit(0).cast("long").alias("j")))

    few = targets.count() <= BROADCAST_SOURCES
    small = lambda df: F.broadcast(df) if few else df
    ratio = F.col("target") / F.col("source_size")
    fraction = F.col("ratio") - F.floor("ratio")
    again = lambda u: F.floor((F.col("j") + 1) * fraction + u) - F.floor(F.col("j") * fraction + u)
    out = ranked.join(small(targets), "source_key").withColumn("ratio", F.when(F.col("source_size") > 0, ratio).otherwise(0.0))
    out = c.materialise(out, "ranked")
    phases = [F.lit((k + 0.5) / PHASES) for k in range(PHASES)]
    sums = out.groupBy("source_key").agg(F.first("target").alias("t"), *[F.sum((F.floor("ratio") + again(u)) * F.col("size")).alias(f"p{k}") for k, u in enumerate(phases)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"p{k}") - F.col("t")).alias("miss"), u.alias("u")) for k, u in enumerate(phases)]))["u"]
    out = out.join(small(sums.select("source_key", best.alias("u"))), "source_key")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.floor("ratio") + again(F.col("u"))).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(c.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
