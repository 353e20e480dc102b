"""Embeddings without a model: hashed bigrams, text hashes, pooled tables; and Unicode normal forms.

Arrow functions, since they need 64-bit wrap-around or tables that Column expressions lack.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def _unit(v: np.ndarray) -> list[float]:
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).astype(np.float32).tolist()


#: Characters that are counted at once, and pairs of distinct characters that have a place in a table.
SLICE_CHARS, MOST_PAIRS = 1_000_000, 4_000_000


def bigram_counts(texts: list[str], dim: int, known: dict[int, int]) -> np.ndarray:
    """(texts, dim): how many adjacent pairs of characters each text has in each hashed dimension; known keeps hashes."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    out = np.zeros((len(texts), dim))
    if len(code) > 1:
        chars = np.flatnonzero(np.bincount(code))
        rank = np.zeros(chars[-1] + 1, dtype=np.int64)
        rank[chars] = np.arange(len(chars))
        own, at = np.repeat(np.arange(len(texts)), lengths), rank[code]
        inside = own[:-1] == own[1:]
        pairs = (at[:-1] * len(chars) + at[1:])[inside]
        if len(chars) ** 2 <= MOST_PAIRS:
            table = np.zeros(len(chars) ** 2, dtype=np.int64)
            table[pairs] = 1
            found = np.flatnonzero(table)
            table[found] = np.arange(len(found))
            which = table[pairs]
        else:
            found, which = np.unique(pairs, return_inverse=True)
        names = (chars[found // len(chars)] << 21 | chars[found % len(chars)]).tolist()
        for pair in names:
            if pair not in known:
                known[pair] = fnv1a((chr(pair >> 21) + chr(pair & 0x1FFFFF)).encode()) % dim
        dims = np.array([known[pair] for pair in names], dtype=np.int64)
        out += np.bincount(own[:-1][inside] * dim + dims[which], minlength=out.size).reshape(out.shape)
    for i in np.flatnonzero(lengths == 1):
        out[i, fnv1a(texts[i].encode()) % dim] += 1
    return out


def bigram_embedding(text: Column, dim: int = 256, spaces: bool = True) -> Column:
    """Counts of adjacent pairs of characters in hashed dimensions, at unit length; spaces=False drops white space."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[int, int] = {}
        own = [t or "" for t in texts]
        own = own if spaces else ["".join(t.split()) for t in own]
        ends, out, first = np.cumsum([len(t) for t in own]), [], 0
        while first < len(own):
            upto = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_CHARS, "right"))
            upto = max(upto, first + 1)
            v = bigram_counts(own[first:upto], dim, known)
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out += list((v / np.where(n == 0, 1, n)).astype(np.float32))
            first = upto
        return pd.Series(out, index=texts.index, dtype=object)

    return run(text)


def hash_embedding(text: Column, dim: int) -> Column:
    """Dimension i is the text's hash rotated by 7 * i bits, its low half as a signed share of the largest."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        turns = np.arange(dim, dtype=np.uint64) * np.uint64(7) % np.uint64(64)
        back = (np.uint64(64) - turns) % np.uint64(64)

        def one(t):
            h = np.full(dim, fnv1a((t or "").encode()), dtype=np.uint64)
            turned = np.where(turns == 0, h, (h << turns) | (h >> back))
            return (turned.astype(np.uint32).view(np.int32) / np.float32(2**31 - 1)).astype(np.float32).tolist()

        return texts.map(one)

    return run(text)


def pooled_embedding(ids: Column, weights: np.ndarray) -> Column:
    """The mean of the rows that token ids name, at unit length; ids past the table are skipped.

    weights: a table of vocabulary size times dimensions, sent to each worker once.
    """
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(np.asarray(weights, dtype=np.float32))

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        w = shared.value

        def one(x):
            own = np.array([i for i in (x if x is not None else []) if 0 <= i < len(w)], dtype=np.int64)
            return _unit(w[own].mean(axis=0) if len(own) else np.zeros(w.shape[1]))

        return rows.map(one)

    return run(ids)


def nfkc(text: Column) -> Column:
    """Compatibility normal form; plain ASCII texts stay in the JVM, the function gets nulls in their place."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(run(F.when(~plain, text)))
