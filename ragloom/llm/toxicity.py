"""Toxicity: a logistic classifier of words with a counterfactual penalty.

Features are the distinct words of the whole text and their five-byte heads, hashed into a fixed
table. A bounded sample of labelled rows (`sample` rows by hash of doc_id) trains on the driver: a
two-proportion z-test keeps the telling features, then logistic loss is minimised together with
`penalty` times the squared change of the score where identity terms are swapped for others of their
group. Words for groups thereby get no weight of their own, so that neutral mentions stay clean.

Scoring reads every text once, without a shuffle; the weights sent to tasks have a fixed size.

Null and empty texts get the score of a text without features. Labels that are null, or of no document,
are ignored; a doc_id labelled twice counts as toxic if any of its labels says so. With no label of one
class there is nothing to learn and every score is the share of toxic labels (0 without labels). Long
texts are read whole. Repeated documents are scored alike; an empty table gives an empty result. Other
columns of the input are kept out of the score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Labelled rows to learn from, at most.
SAMPLE = 6_000
BITS = 18
HEAD = 5
Z_LEAST, Z_FEATURES = 4.0, 3_000
PENALTY, RIDGE, STEPS = 4.0, 1e-4, 400

#: Terms that may be swapped within a group without changing whether a sentence is toxic.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("young", "old", "elderly", "disabled", "blind", "deaf"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
)
_SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
_TERM = re.compile(r"(?i)\b(" + "|".join(_SWAP) + r")\b")


def swap_identity(text: str) -> str:
    """The counterfactual: each identity term replaced by the next of its group."""
    return _TERM.sub(lambda m: _SWAP[m[1].lower()], text)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: (text number, feature), sorted."""
    owners, out = [], []
    for lo, hi in c.pieces(texts):
        joined = b" ".join(texts[lo:hi]).lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        starts, ends = c.word_spans(data, c.ALNUM)
        prefix = c.prefix_hash(data)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])])
        own = np.searchsorted(at, starts, side="right") - 1 + lo
        word = c.span_hash(prefix, starts, ends) >> np.uint64(64 - BITS)
        head = (c.span_hash(prefix, starts, np.minimum(ends, starts + HEAD)) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
        both = np.unique(np.concatenate([own, own]).astype(np.int64) << (BITS + 1) | np.concatenate([word, head]).astype(np.int64))
        owners.append((both >> (BITS + 1)).astype(np.int32))
        out.append((both & (1 << BITS + 1) - 1).astype(np.int32))
    return (np.concatenate(owners), np.concatenate(out)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.int32))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.index = np.flatnonzero(weights).astype(np.int32)
        self.values, self.bias = weights[self.index], bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS + 1)
        out[self.index] = self.values
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        w = self.table()
        own, f = features(texts)
        return sigmoid(np.bincount(own, weights=w[f], minlength=len(texts)) + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[bytes], labels: np.ndarray, penalty: float = PENALTY) -> Model:
    """Fits the weights; texts and labels are the bounded sample."""
    n, size = len(texts), 1 << BITS + 1
    toxic = labels.astype(bool)
    rate = float(toxic.mean()) if n else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(size), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    own, f = features(texts)
    on = np.bincount(f[toxic[own]], minlength=size) / toxic.sum()
    off = np.bincount(f[~toxic[own]], minlength=size) / (~toxic).sum()
    mean = np.bincount(f, minlength=size) / n
    z = (on - off) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / toxic.sum() + 1 / (~toxic).sum()))
    terms = np.unique(features([t.encode() for t in _SWAP])[1])
    best = np.argsort(-np.abs(z), kind="stable")[:Z_FEATURES]
    kept = np.union1d(best[np.abs(z[best]) >= Z_LEAST], terms)
    column = np.full(size, -1, dtype=np.int64)
    column[kept] = np.arange(len(kept))

    def matrix(own, f):
        ok = column[f] >= 0
        return own[ok], column[f[ok]]

    rows, cols = matrix(own, f)
    del own, f
    pairs = [i for i, t in enumerate(texts) if _TERM.search(t.decode(errors="replace"))]
    other_rows, other_cols = matrix(*features([swap_identity(texts[i].decode(errors="replace")).encode() for i in pairs]))
    w, b = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    gw, gb = np.full(len(kept), 1e-8), 1e-8
    for _ in range(STEPS):
        p = sigmoid(np.bincount(rows, weights=w[cols], minlength=n) + b)
        g = (p - toxic) / n
        grad = np.bincount(cols, weights=g[rows], minlength=len(kept)) + RIDGE * w
        if pairs:
            q = sigmoid(np.bincount(other_rows, weights=w[other_cols], minlength=len(pairs)) + b)
            own_p = p[pairs]
            gap = penalty * 2 * (own_p - q) / len(pairs)
            back = np.zeros(n)
            back[pairs] = gap * own_p * (1 - own_p)
            grad += np.bincount(cols, weights=back[rows], minlength=len(kept)) - np.bincount(other_cols, weights=(gap * q * (1 - q))[other_rows], minlength=len(kept))
        gw += grad**2
        gb += g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * g.sum() / np.sqrt(gb)
    weights = np.zeros(size)
    weights[kept] = w
    return Model(weights, b)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows of the training folds, drawn by hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    own = own.where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.toArrow().sort_by([("doc_id", "ascending")])
    model = train(c.texts_of(rows.column("text").combine_chunks()), rows.column("toxic").to_numpy())
    del rows
    c.release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to docs."""
    names = docs.columns
    out = "ragloom_score" if "score" in names else "score"
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in c.slices(batches, at):
            column = batch.column(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(c.texts_of(column)))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, held_out, score, predicted) of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    got = score(own, fit(own, labels, sample))
    return got.withColumn("held_out", ~F.coalesce(in_training(F.col("doc_id")), F.lit(True))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, c.table(spark, sf_dir, "labels"))
    got = score(docs, model).drop("text")
    return got.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
