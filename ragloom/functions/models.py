"""Local language models as a table, and whether a host can run them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = "family string, label string, repo string, file string, size_mb int, quant string, base string"
# The models, KiB of cache a token at 16 bits, the share that quantised caches take, MB of overhead and reserve.
CATALOGUE = (
    ("gemma4", "Gemma 4 E2B (IQ4_XS)", "unsloth/gemma-4-E2B-it-GGUF", "gemma-4-E2B-it-IQ4_XS.gguf", 1693, "IQ4_XS", "gemma-4-E2B"),
    ("gemma4", "Gemma 4 E4B (IQ4_XS)", "unsloth/gemma-4-E4B-it-GGUF", "gemma-4-E4B-it-IQ4_XS.gguf", 2715, "IQ4_XS", "gemma-4-E4B"),
    ("gemma4", "Gemma 4 26B-A4B (IQ4_XS, MoE)", "unsloth/gemma-4-26B-A4B-it-GGUF", "gemma-4-26B-A4B-it-UD-IQ4_XS.gguf", 12797, "IQ4_XS", "gemma-4-26B-A4B"),
    ("qwen", "Qwen 3.6 27B (IQ4_XS)", "unsloth/Qwen3.6-27B-GGUF", "Qwen3.6-27B-IQ4_XS.gguf", 14725, "IQ4_XS", "qwen-3.6-27B"),
)
CACHE_KIB = {"gemma-4-E2B": 120, "gemma-4-E4B": 140, "gemma-4-26B-A4B": 200, "qwen-3.6-27B": 130}
OTHER_KIB = 150
SHARES = {1.0: ("f16", "fp16", "bf16", "f32", "fp32"), 0.55: ("q8_0", "q8_1", "q8"), 0.40: ("q5_0", "q5_1", "q5"), 0.30: ("q4_0", "q4_1", "q4")}
OTHER_SHARE = 0.55
OVERHEAD_MB, RESERVE_MB, TIGHT = 1536, 4096, 1.10


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, MODELS)


def cache_mb(base: Column, n_ctx: Column, cache_type: Column) -> Column:
    """MB of the key-value cache of n_ctx tokens."""
    kib = F.coalesce(F.get(F.array(*[F.lit(v) for v in CACHE_KIB.values()]), F.array_position(F.array(*[F.lit(k) for k in CACHE_KIB]), base).cast("int") - 1), F.lit(OTHER_KIB))
    share = F.lit(OTHER_SHARE)
    for value, names in SHARES.items():
        share = F.when(F.lower(cache_type).isin(*names), F.lit(value)).otherwise(share)
    return F.round(kib * n_ctx * share / 1024).cast("int")


def feasibility(rows: DataFrame) -> DataFrame:
    """Adds projected_kv_mb, projected_total_mb, available_mb and status to models with their hosts.

    rows: size_mb, base, n_ctx, kv_type, mode (unified, cpu or gpu), total_ram_mb, free_vram_mb.
    """
    ram = F.greatest(F.col("total_ram_mb") - RESERVE_MB, F.lit(0))
    got = rows.withColumn("projected_kv_mb", cache_mb(F.col("base"), F.col("n_ctx"), F.col("kv_type")))
    got = got.withColumn("projected_total_mb", F.col("size_mb") + F.col("projected_kv_mb") + OVERHEAD_MB)
    got = got.withColumn("available_mb", F.when(F.col("mode") == "gpu", ram + F.coalesce("free_vram_mb", F.lit(0))).otherwise(ram))
    fits = lambda x: F.col("projected_total_mb") <= F.col("available_mb") * x
    return got.withColumn("status", F.when(fits(1), "ok").when(fits(F.lit(TIGHT)), "tight").otherwise("insufficient"))
