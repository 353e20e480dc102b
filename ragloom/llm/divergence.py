"""Source divergence audit: exact distances between the word distributions of the sources of a language.

Each language keeps the terms that at least MIN_DOCS of its documents hold, V of them. A group (a source of a
language, or the whole language) gives a kept term that occurs n times there the price
p(n) = 1 + floor(UNIT * (n + PRIOR) / (N + PRIOR * V)), N being the group's occurrences of kept terms. The
distance of two groups is the sum of |p - q| over all kept terms, those of neither group included. It is never
summed over V terms a pair; by inclusion and exclusion over the supports it is the sum of

- for each of the two, its histogram (how many terms occur n times) priced against the other's p(0);
- |p(0) - q(0)| for V less both supports;
- for each term in both supports, |p - q| less the two one-sided prices, plus |p(0) - q(0)|: what the three
  above got wrong. Only this joins postings, by term, and only pairs of groups that share one.

One scan counts terms: each task sums the occurrences and documents of a slice of texts by (group, term), by
64-bit hashes of terms (two terms agree with probability 2**-64) beside one copy of the term, so what is
shuffled is sums and no source or frequent word is hot. Every later table has one row for a (group, term), a
(group, count) or a pair. Integers are exact: products go through decimals.

A null text, language or source is the empty string. Groups without terms occur all the same, with N = 0. Where a
language keeps no terms all distances are 0 and no terms are listed. Ties go to the lesser item by its UTF-8
bytes. Repeated rows count each. Very long texts are read whole. An empty table gives no rows. Further columns
of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

MIN_DOCS, UNIT, PRIOR, TOP = 30, 1_000_000_000, 5, 50
GROUP = ["lang", "source"]


def _counts(batches):
    """(lang, source, term, n, docs) of each slice; a group has a row without a term as well."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in c.slices(batches, 0):
        names = [pc.fill_null(batch.column(k), "").dictionary_encode() for k in (1, 2)]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
        group = lang * len(names[1].dictionary) + source
        texts = c.texts_of(batch.column(0))
        out = [(g, None, 0, 0) for g in np.unique(group).tolist()]
        for lo, hi in c.pieces(texts):
            joined = b" ".join(texts[lo:hi]).lower()
            data = np.frombuffer(joined, dtype=np.uint8)
            starts, ends = c.word_spans(data, c.LETTERS)
            if not len(starts):
                continue
            at = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            doc = np.searchsorted(at, starts, side="right")
            key = c.span_hash(c.prefix_hash(data), starts, ends)
            # sorted by group, term and document: runs of all three are documents, runs of two are the sums
            own = group[lo:hi][doc]
            order = np.lexsort((doc, key, own))
            key, own, doc = key[order], own[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            newer = new | np.concatenate([[True], doc[1:] != doc[:-1]])
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(key)]]))
            docs = np.add.reduceat(newer.astype(np.int64), first)
            where = order[first]
            terms = [joined[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            out += zip(own[first].tolist(), terms, n.tolist(), docs.tolist(), strict=True)
        codes = np.array([x[0] for x in out], dtype=np.int64)
        width = max(len(names[1].dictionary), 1)
        columns = [names[0].dictionary.take(pa.array(codes // width)), names[1].dictionary.take(pa.array(codes % width)), pa.array([x[1] for x in out], pa.string()), *(pa.array([x[k] for x in out], pa.int64()) for k in (2, 3))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), null where that divides by 0."""
    wide = lambda x: x.cast("decimal(19,0)")
    below = F.nullif(total + kept * PRIOR, F.lit(0).cast("long"))
    # a quotient of whole decimals: no digit is lost, and it is UNIT at most for the sums of a group
    return F.call_function("div", wide(n + PRIOR) * F.lit(UNIT), wide(below)) + 1


def term_tables(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, n, p, q) of kept terms, and groups (lang, source, kept, z, support), z = p(0)."""
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counted = own.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = c.materialise(counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    terms = counted.where("term is not null")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    vocabulary = c.materialise(vocabulary, "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("all"))
    posted = c.materialise(terms.drop("docs").join(vocabulary, ["lang", "term"]), "kept")
    sizes = posted.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counted.where("term is null").select(*GROUP).join(langs, "lang", "left").join(sizes, GROUP, "left").na.fill(0, ["kept", "all", "total", "support"])
    groups = c.materialise(groups.withColumn("z", price(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")
    posted = posted.join(groups, GROUP).withColumn("p", price(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", price(F.col("whole"), F.col("all"), F.col("kept")))
    return c.materialise(posted.select(*GROUP, "term", "n", "p", "q", "z"), "postings"), groups.select(*GROUP, "kept", "z", "support")


def _other(df: DataFrame, *names: str) -> DataFrame:
    return df.select("lang", *[F.col(x).alias(f"{x}_b") for x in names])


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each two sources of a language, both ways round."""
    pairs = c.materialise(groups.join(_other(groups, "source", "z", "support"), "lang").where("source <> source_b"), "pairs")
    histogram = postings.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    one = pairs.select(*GROUP, "source_b", "z_b").join(histogram, GROUP).groupBy(*GROUP, "source_b").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("z_b"))).alias("one"))
    one = c.materialise(one, "one")
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    right = apart("p", "p_b") - apart("p", "z_b") - apart("z", "p_b") + apart("z", "z_b")
    both = postings.join(_other(postings, "source", "term", "p", "z").withColumnRenamed("term_b", "term"), ["lang", "term"]).where("source < source_b")
    both = c.materialise(both.groupBy(*GROUP, "source_b").agg(F.sum(right).alias("both")), "both")
    neither = (F.col("kept") - F.col("support") - F.col("support_b")) * apart("z", "z_b")
    back = one.select("lang", F.col("source_b").alias("source"), F.col("source").alias("source_b"), F.col("one").alias("back"))
    half = pairs.where("source < source_b").select(*GROUP, "source_b", neither.alias("neither"))
    for x in (one, back, both):
        half = half.join(x, [*GROUP, "source_b"], "left")
    value = sum((F.coalesce(F.col(x), F.lit(0)) for x in ("neither", "one", "back", "both")), F.lit(0).cast("long"))
    half = c.materialise(half.select(*GROUP, F.col("source_b").alias("item"), value.alias("value")), "distances")
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, distances to the other sources; part term, the top terms that a source has more of than its language."""
    postings, groups = term_tables(docs, min_docs)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))
    columns = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = postings.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return columns(pair_distances(postings, groups), "pair").unionByName(columns(terms, "term").where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(c.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM k GROUP BY lang),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000 * (coalesce(n.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p, 1 + (1000000000 * (k.whole + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
