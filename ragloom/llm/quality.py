"""Quality rules: base counts, and robust multivariate outliers per language and source.

Of the documents that pass the base rules, four transformed statistics (length of words, share of
symbols, of repeated lines and of repeated words) are held against a minimum-covariance-determinant
estimate of their language and source: of all subsets of a share SUPPORT of its documents, the one whose covariance
has the least determinant. It is searched from STARTS starts (medians and quartile ranges, the mean and
covariance of all, and those of seeded subsets); a concentration step keeps the documents with the least
distances and takes their mean and covariance, which lowers the determinant; steps go on until no start's
determinant falls any more (MOST_STEPS at most; then the least so far holds), and the start with the least
determinant gives the estimate. Covariances are regularised: FLOORS squared are added to the variances. The
covariance is then scaled so that the median distance is that of the chi-squared law, and a document is
rejected where its squared Mahalanobis distance exceeds CUTOFF.

Everything is a DataFrame function: each step is one map-side combined aggregation by group and
distance bin, so no group is gathered and a group of any size costs a table of bins. Statistics are
fixed-point integers, so sums do not depend on the order of rows. Documents of
a group of fewer than LEAST passing documents are judged by an estimate over all passing documents of
their language, other groups' included; where the language has fewer than LEAST too, by one over the
whole corpus, however small. So every document that passes the base rules has a distance and a verdict.

Null texts have no words and fail the base rules (n_words < 10). A null language or source is a group
of its own. Repeated rows count as often as they stand; ties share a bin, hence a verdict. An empty
table gives an empty result. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .native import let

DIMS = ("x1", "x2", "x3", "x4")
#: Fixed-point unit of the statistics.
UNIT = 4096
#: Added in quadrature to each statistic's spread: differences below it tell nothing.
FLOORS = (0.05, 0.35, 0.06, 0.05)
SUPPORT, LEAST = 0.75, 50
#: Starts of the search, concentration steps at most, and the fall of the log-determinant that counts.
STARTS, MOST_STEPS, FALL = 5, 25, 1e-6
#: chi-squared with 4 degrees of freedom: its median, and the point beyond which 1 in 10**6 lies.
MEDIAN, CUTOFF = 3.3567, 33.38
#: The median may scale distances up by this much at most: where floors make up a spread, it is low.
SCALE = 1.5
WINDOW = 5
BINS = 32
#: Estimates (about 200 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside windows of n words that stand in the array twice or more."""

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

        def with_windows(w: Column) -> Column:
            placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def again(s: Column) -> Column:
                same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
                at = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
                begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
                return F.aggregate(at, begin, lambda a, p: F.struct((a["n"] + p + n - F.greatest(p, a["to"])).alias("n"), (p + n).alias("to")), lambda a: a["n"])

            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, again))

        return F.when(F.size(hashes) < n, F.lit(0)).otherwise(let(windows, with_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def base_counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": both,
        "word_chars": F.length(F.regexp_replace(t, _SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base rules: counts of each document and whether they fail it."""
    got = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *[v.alias(k) for k, v in base_counts(F.col(text_col)).items()])
    got = got.select("doc_id", "lang", "source", "words.n_words", "word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines", "words.n_repeat_words")
    return got.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _statistics(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (
        F.log(F.greatest(ratio("word_chars", "n_words"), F.lit(0.1))),
        F.log1p(ratio("n_symbols", "word_chars") * 100),
        ratio("n_dup_lines", "n_lines"),
        ratio("n_repeat_words", "n_words"),
    )
    return counts.select("*", *[F.round(v * UNIT).cast("long").alias(k) for k, v in zip(DIMS, values, strict=True)])


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds group, whose estimate judges the document, and teaches, the groups whose estimates it enters."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("-")) for k in ("lang", "source"))
    own = stats.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    same = Window.partitionBy("lang")
    own = own.withColumn("small", F.col("n") < LEAST).withColumn("rare", F.sum("n").over(same) < LEAST)
    own = c.materialise(own.withColumn("pools", F.max(F.col("small") & (F.col("n") > 0)).over(same)), "groups")
    whole = F.lit(None if own.where("rare and n > 0").isEmpty() else "*").cast("string")
    alone = F.concat_ws("\u0001", lang, source)
    group = F.when(~F.col("small"), alone).when(~F.col("rare"), lang).otherwise("*")
    teaches = F.array_compact(F.array(F.when(~F.col("small"), alone), F.when(~F.col("rare") & F.col("pools"), lang), whole))
    names = own.select(F.col("lang").alias("l"), F.col("source").alias("s"), group.alias("group"), teaches.alias("teaches"))
    names = F.broadcast(names) if own.count() <= BROADCAST_ROWS else names
    return stats.join(names, stats["lang"].eqNullSafe(names["l"]) & stats["source"].eqNullSafe(names["s"])).drop("l", "s")


def _distance() -> Column:
    """Squared distance of x1..x4 under the centre m1..m4 and the whitening rows w11, w21, ..., w44."""
    out = F.lit(0.0)
    for i in range(4):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i + 1}{j + 1}") * (F.col(f"x{j + 1}") / UNIT - F.col(f"m{j + 1}"))
        out = out + z * z
    return out


def _whitening(estimate: DataFrame) -> DataFrame:
    """From m1..m4 and the covariances c11, c21, ..., c44: rows of the inverse of its Cholesky factor."""
    e = estimate
    for j in range(1, 5):
        inner = F.lit(0.0)
        for k in range(1, j):
            inner = inner + F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        e = e.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(FLOORS[j - 1] ** 2 / 4))))
        for i in range(j + 1, 5):
            inner = F.lit(0.0)
            for k in range(1, j):
                inner = inner + F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            e = e.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}"))
    for i in range(1, 5):
        e = e.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i - 1, 0, -1):
            inner = F.lit(0.0)
            for k in range(j, i):
                inner = inner + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            e = e.withColumn(f"w{i}{j}", -inner / F.col(f"l{i}{i}"))
    e = e.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, 5)), F.lit(0.0)))
    return e.select("group", "start", "logdet", *[f"m{i}" for i in range(1, 5)], *[f"w{i}{j}" for i in range(1, 5) for j in range(1, i + 1)])


def _start(stats: DataFrame) -> DataFrame:
    """Medians and quartile ranges, from counts of fixed-point values."""
    long = stats.select("group", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col(x).alias("v")) for i, x in enumerate(DIMS)])).alias("s")).select("group", "s.k", F.floor(F.col("s.v") / 16).alias("bin"))
    bins = long.groupBy("group", "k", "bin").agg(F.count("*").alias("n"))
    part = Window.partitionBy("group", "k")
    run = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("run", run).withColumn("all", F.sum("n").over(part))
    at = lambda q: F.min(F.when(F.col("run") >= F.col("all") * q, F.col("bin"))) * F.lit(16.0 / UNIT)
    q = bins.groupBy("group", "k").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    wide = q.groupBy("group").agg(*[F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(1, 5)], *[F.max(F.when(F.col("k") == i, F.pow((F.col("hi") - F.col("lo")) / 1.349, F.lit(2)) + FLOORS[i - 1] ** 2)).alias(f"c{i}{i}") for i in range(1, 5)])
    return _whitening(wide.select("*", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"c{i}{j}") for i in range(1, 5) for j in range(1, i)]))


def _bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-4) * BINS).cast("long")


_PAIRS = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
_SUMS = [f"s{i}" for i in range(1, 5)] + [f"s{i}{j}" for i, j in _PAIRS]


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Numbers, sums and sums of products of the statistics."""
    exact = lambda x, k: F.sum(x.cast("decimal(20,0)")).alias(k)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[exact(F.col(f"x{i}"), f"s{i}") for i in range(1, 5)], *[exact(F.col(f"x{i}") * F.col(f"x{j}"), f"s{i}{j}") for i, j in _PAIRS])


def _estimate(sums: DataFrame) -> DataFrame:
    """Mean and covariance by (group, start)."""
    g = sums.groupBy("group", "start").agg(F.sum("n").cast("double").alias("n"), *[F.sum(k).cast("double").alias(k) for k in _SUMS])
    cov = [((F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) / UNIT**2 + F.lit(FLOORS[i - 1] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return _whitening(g.select("group", "start", *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(1, 5)], *cov))


def _starts(stats: DataFrame) -> DataFrame:
    """Start 0: medians and quartile ranges; 1: all documents; others: seeded eighths."""
    some = F.filter(F.sequence(F.lit(1), F.lit(STARTS - 1)), lambda k: (k == 1) | (F.pmod(F.xxhash64(*DIMS, k), F.lit(8)) == 0))
    return _start(stats).unionByName(_estimate(_sums(stats.withColumn("start", F.explode(some)), "group", "start")))


def _few(stats: DataFrame):
    """Hints a broadcast of estimates where stats have few groups; rows of a hot group then stay where they are."""
    few = stats.select("group").distinct().count() * STARTS <= BROADCAST_ROWS
    return lambda estimate: F.broadcast(estimate) if few else estimate


def _concentrate(stats: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step of every (group, start) of estimate."""
    d = stats.join(estimate, "group").withColumn("d2", _distance()).withColumn("bin", _bin())
    part = Window.partitionBy("group", "start")
    before = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bins = _sums(d, "group", "start", "bin").withColumn("before", before).withColumn("all", F.sum("n").over(part))
    return _estimate(bins.where(F.col("before") < F.ceil(F.col("all") * SUPPORT)))


def least_determinant(stats: DataFrame) -> DataFrame:
    """The estimate of each group of stats (group, x1..x4): that of least determinant over starts and steps."""
    moving, found, small = c.materialise(_starts(stats), "mcd"), None, _few(stats)
    for step in range(MOST_STEPS):
        new = c.materialise(_concentrate(stats, small(moving)), "mcd")
        found = new if found is None else found.unionByName(new)
        if step:
            before = moving.select("group", "start", F.col("logdet").alias("before"))
            new = new.join(before, ["group", "start"]).where(F.col("logdet") < F.col("before") - FALL).drop("before")
        if new.isEmpty():
            break
        moving = new
    names = [x for x in found.columns if x != "group"]
    best = found.groupBy("group").agg(F.min(F.struct("logdet", *[x for x in names if x != "logdet"])).alias("best"))
    return best.select("group", *[F.col(f"best.{x}").alias(x) for x in names])


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, base_failed, distance (squared, null where the base rules fail) and kept, per document."""
    counts = c.materialise(_statistics(quality_counts(docs)), "counts")
    stats = _grouped(counts)
    passed = stats.where(~F.col("base_failed")).select(F.explode("teaches").alias("group"), *DIMS)
    estimate = c.materialise(least_determinant(passed), "mcd")
    small = _few(stats)
    bins = passed.join(small(estimate), "group").withColumn("d2", _distance()).groupBy("group", _bin().alias("bin")).agg(F.count("*").alias("n"))
    part = Window.partitionBy("group")
    run = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = bins.withColumn("run", run).withColumn("all", F.sum("n").over(part)).where(F.col("run") * 2 >= F.col("all")).groupBy("group").agg(F.exp(F.min("bin") / BINS).alias("middle"))
    scaled = c.materialise(estimate.join(middle, "group").withColumn("scale", F.lit(MEDIAN) / F.greatest("middle", F.lit(MEDIAN / SCALE))), "mcd")
    out = stats.join(small(scaled), "group", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() * F.col("scale")))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(c.table(spark, sf_dir, "documents"))
