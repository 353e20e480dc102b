"""The corpus pipeline: filter, deduplicate, decontaminate, redact and mix the documents of sf_dir.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents; further columns go, whatever their names. Null and empty texts are kept by the
filters and have size 0 in the mix. Of equal texts the document with the least doc_id stays. A document without
a doc_id goes under a key made of its text, which is above all ids: it is a copy of a named one before it is
kept for itself. Texts are read whole, however long. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import common as c
from ragloom.llm import decontaminate, mixing, ngram_jaccard, secret_scan, toxicity
from ragloom.llm.native import let

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: doc_ids to drop up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
PLACEHOLDER = "[SECRET]"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, c.row_key("doc_id", "text").alias("ragloom_key"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of _keyed whose key is not among the doc_ids of keys."""
    keys = c.materialise(keys.select(F.col("doc_id").alias("ragloom_key")), "dropped")
    return keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "ragloom_key", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.select(*COLUMNS)
    model = toxicity.fit(own, c.table(spark, sf_dir, "labels"))
    return toxicity.score(own, model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays."""
    keyed = _keyed(docs)
    groups = ngram_jaccard.ngram_jaccard_join(keyed, id_col="ragloom_key")
    return _without(keyed, groups.where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontaminate.decontaminate(keyed.drop("doc_id").withColumnRenamed("ragloom_key", "doc_id"), c.table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.where("n_hit > 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans found become PLACEHOLDER; n_chars counts what is left."""

    def redact(spans):
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a, s):
            gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
            grown = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.when(s["start"] >= a["at"], F.lit(PLACEHOLDER)).otherwise("")).alias("out"))
            return F.when(s["end"] <= a["at"], a).otherwise(grown)

        return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))

    spans = secret_scan.spans_of(F.col("text"), secret_scan.fit(docs))
    clean = docs.withColumn("text", F.col("text").cast("string")).withColumn("ragloom_spans", spans)
    some = F.size("ragloom_spans") > 0
    text = F.when(some, let(F.col("ragloom_spans"), redact)).otherwise(F.col("text"))
    clean = clean.withColumn("redacted", text).withColumn("n_chars", F.when(some, F.length("redacted").cast("long")).otherwise(F.col("n_chars")))
    return clean.withColumn("text", F.col("redacted")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's input."""
    docs = c.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = c.materialise(docs, f"stage-{k}")
    return docs
