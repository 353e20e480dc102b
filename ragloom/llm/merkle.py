"""WARC fixity audit: Merkle trees over records and ordered offset ranges, compared between replicas.

A record's leaf is the SHA-256 of its bytes at its declared offset. Records whose offsets fall into the
same range of `span` bytes form a range node, and FANOUT neighbouring nodes form the node above, up to one
root per file. Roots of two replicas are compared first; only children of mismatching nodes are looked
at on the next level, down to the records, so an audit of sound replicas reads one row per file.

A node has at most FANOUT children, and a range at most span offsets, so no aggregation gathers
more than that; files of any size only add levels. Tree nodes are tables in the shared folder. Bytes are
hashed where they are read: only digests are shuffled.

A record of null bytes counts as empty. Where a replica has no record at an offset that the other has,
the record is missing (or extra). Repeated records (same file and offset) fold into one leaf, of their number
and the sums of the words of their digests, so that any number of them costs one row; records at a null
offset are such repeats, at the result's null offset. A null file is a file. Very long records are records.
Empty tables are sound; if one replica is empty, every record of the other is missing or
extra. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

FANOUT, SPAN = 16, 1 << 18
#: Records of a file of the audit query.
FILE_RECORDS = 1024


def digest_of(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload.cast("binary"), F.lit("").cast("binary")), 256)


def leaves(records: DataFrame, span: int = SPAN) -> DataFrame:
    """(file_id, offset, digest, node): node is the offset range that the record lies in.

    records: file_id, offset, and payload or digest, the digest of the payload. file_id becomes a struct, so
    that null equals null; a null offset is -1.
    """
    d = F.col("digest") if "digest" in records.columns else digest_of(F.col("payload"))
    got = records.select(F.struct("file_id").alias("file_id"), F.coalesce(F.col("offset").cast("long"), F.lit(-1).cast("long")).alias("offset"), d.alias("d"))
    word = lambda k: F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    got = got.groupBy("file_id", "offset").agg(F.count("*").alias("n"), F.min("d").alias("d"), *[F.sum(word(k)).alias(f"w{k}") for k in range(8)])
    several = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in ("n", *(f"w{k}" for k in range(8)))]), 256)
    return got.select("file_id", "offset", F.when(F.col("n") > 1, several).otherwise(F.col("d")).alias("digest"), F.floor(F.col("offset") / span).cast("long").alias("node"))


def _fold(rows: DataFrame, order: str) -> DataFrame:
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("digest")))), lambda x: F.concat_ws(":", x[order].cast("string"), x["digest"]))
    return rows.groupBy("file_id", "node").agg(F.sha2(F.array_join(each, ","), 256).alias("digest"))


def levels_above(ranges: DataFrame) -> int:
    """Levels from the range nodes to one root per file."""
    most = ranges.agg(F.max("node")).collect()[0][0]
    level = 0
    while most and most > 0:
        most //= FANOUT
        level += 1
    return level


def build_trees(*leaf: DataFrame) -> list[list[DataFrame]]:
    """Nodes (file_id, node, digest) by level of each table of leaves, ranges first, one root per file last; all of one height."""
    trees = [[c.materialise(_fold(x, "offset"), "merkle")] for x in leaf]
    for _ in range(max(levels_above(t[0]) for t in trees)):
        for t in trees:
            up = t[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
            t.append(c.materialise(_fold(up, "child"), "merkle"))
    return trees


def audit(one: DataFrame, two: DataFrame, span: int = SPAN) -> DataFrame:
    """(file_id, offset, status): records of one and two that differ: changed, missing (in two) or extra."""
    a, b = c.materialise(leaves(one, span), "leaves"), c.materialise(leaves(two, span), "leaves")
    tree_a, tree_b = build_trees(a, b)
    wrong = None
    for level_a, level_b in zip(reversed(tree_a), reversed(tree_b), strict=True):
        if wrong is not None:
            below = wrong.select("file_id", F.col("node").alias("up"))
            under = lambda x, below=below: x.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(below, ["file_id", "up"], "left_semi").drop("up")
            level_a, level_b = under(level_a), under(level_b)
        both = level_a.withColumnRenamed("digest", "da").join(level_b.withColumnRenamed("digest", "db"), ["file_id", "node"], "full")
        wrong = c.materialise(both.where(~F.col("da").eqNullSafe(F.col("db"))).select("file_id", "node"), "wrong")
    own = lambda x, name: x.join(wrong, ["file_id", "node"], "left_semi").select("file_id", "offset", F.col("digest").alias(name))
    both = own(a, "da").join(own(b, "db"), ["file_id", "offset"], "full").where(~F.col("da").eqNullSafe(F.col("db")))
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("changed")
    return both.select(F.col("file_id.file_id").alias("file_id"), F.when(F.col("offset") >= 0, F.col("offset")).alias("offset"), status.alias("status"))


def replicas(pages: DataFrame, file_records: int = FILE_RECORDS) -> tuple[DataFrame, DataFrame]:
    """Pages as records of files (address, blank line, body), and a replica in which some payloads are altered at
    equal length and some records are lost: file_id, page_id, offset and digest of each record."""
    payload = F.concat(F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", F.floor(F.col("page_id") / file_records).cast("long").alias("file_id"), payload.alias("payload"))
    flipped = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("\u0000"), F.expr("substring(payload, 2)"))).otherwise(F.col("payload"))
    sizes = rows.select("file_id", "page_id", F.octet_length("payload").cast("long").alias("n"), digest_of(F.col("payload")).alias("digest"), digest_of(flipped).alias("other"))
    before = Window.partitionBy("file_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    at = c.materialise(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "records")
    lost = F.col("page_id") % 193 == 7
    return at.select("file_id", "page_id", "offset", "digest"), at.where(~lost).select("file_id", "page_id", "offset", F.col("other").alias("digest"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every page's record against a replica with known damage."""
    return audit(*replicas(c.table(spark, sf_dir, "pages")))


OP7_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {FILE_RECORDS} AS file_id, strlen(coalesce(url, '')) + 4 + strlen(coalesce(html, '')) AS n FROM pages
), o AS (
  SELECT page_id, file_id, CAST(coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r
)
SELECT file_id, "offset", CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE page_id % 193 = 7 OR page_id % 97 = 5
"""
