"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: a block of documents is the unit of indexing and of search, so a
search never gathers the postings of a frequent term in one place. Each row of the index is one term
of one block with its positions in the block, delta-free and sorted; documents of the block are told
apart by their position offsets, kept in one header row of the block.

Windows of benchmark items are searched in a block all at once. Windows of which a term has no postings
there are out. Of the others the rarest term's positions, less the term's offset, are candidate starts;
the list of every further term, less its own offset, is intersected with them, from rare to frequent,
until none is left or the phrase has been matched whole. Proximity search widens the intersection: any
window is near where every term stands within `near` words of the rarest, in one document. There the
rarest is the term with the fewest positions in that document, of ties the window's first, so that a
match does not hang on which other documents share the block; the block's rarest term only names the
documents to look at.

Index rows for terms that no query has cannot matter and are left out where `terms` says so (8 bytes a
distinct term of the benchmark are sent to the tasks). The index is written once; windows are sent to the
tasks in passes of at most QUERY_ROWS over it.

Null texts and texts without words have no postings and are not hit. A null doc_id stays null beside its
document's counts. Items without words have no
window. Repeated documents and items count each for itself, also items of one item_id; an empty table
gives an empty result. An item without an item_id hits like any other and is only left out of items.
Overlapping and repeated matches of a word count it once. Texts are read whole: a text longer than a
block is a block. Words are compared as 64-bit hashes. Other columns are ignored, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

WINDOW = 10
#: Words from the rarest term of a window within which its other terms are near.
NEAR = 15
#: Candidate starts that a task holds at once.
CANDIDATES = 2_000_000
#: Windows that one pass sends to the tasks: WINDOW * 8 bytes each.
QUERY_ROWS = 100_000
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
INDEX = "block long, term long, positions binary, docs binary, named binary, ends binary"


def _index(terms: np.ndarray | None):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        wanted = None if terms is None else np.sort(terms)
        block = TaskContext.get().partitionId() << 32
        for part in c.slices(batches, 1, BLOCK_BYTES):
            if len(part):
                ids = part.column(0)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                yield _block(pa, block, ids.fill_null(0).to_numpy(), named, c.texts_of(part.column(1)), wanted)
                block += 1

    return run


def _block(pa, block: int, ids: np.ndarray, named: np.ndarray, texts: list[bytes], wanted: np.ndarray | None):
    """Rows of the index; named says which ids are not null."""
    words, ends, base = [], [], 0
    for lo, hi in c.pieces(texts):
        w, at = c.hash_words(texts[lo:hi], c.ALNUM)
        words.append(w)
        # a gap of one position between documents: no phrase runs over it
        ends.append(at[1:] + np.arange(1, hi - lo + 1) + base)
        base = int(ends[-1][-1])
    word, end = np.concatenate(words), np.concatenate(ends).astype(np.int64)
    count = np.diff(np.concatenate([[0], end])) - 1
    where = np.arange(len(word)) + np.repeat(np.arange(len(count)), count)
    if wanted is not None:
        near = np.minimum(np.searchsorted(wanted, word), len(wanted) - 1) if len(wanted) else np.zeros(len(word), np.int64)
        keep = wanted[near] == word if len(wanted) else np.zeros(len(word), bool)
        near, where = near[keep], where[keep]
        order = np.argsort(near, kind="stable")
        term, where = wanted[near[order]], where[order].astype(np.int32)
    else:
        order = np.argsort(word, kind="stable")
        term, where = word[order], where[order].astype(np.int32)
    first = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1]) if len(term) else np.zeros(0, np.int64)
    cut = np.append(first, len(term)).astype(np.int32) * 4
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(where.tobytes())])
    rows = len(first)
    none = pa.nulls(rows, pa.binary())
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array(np.full(rows + 1, block)),
            "term": pa.array([0, *c.signed(term[first]).tolist()], pa.int64()),
            "positions": pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
            "docs": pa.concat_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), none]),
            "named": pa.concat_arrays([pa.array([named.astype(np.uint8).tobytes()], pa.binary()), none]),
            "ends": pa.concat_arrays([pa.array([end.tobytes()], pa.binary()), none]),
        }
    )


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of docs, written to the shared folder: a row for each block and term, and a header."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return c.materialise(own.mapInArrow(_index(terms), INDEX), "index")


class Block:
    """Postings of one block in memory."""

    def __init__(self, table):
        term = table.column("term").to_numpy()
        blobs = table.column("positions").to_pylist()
        head = next(i for i, d in enumerate(table.column("docs").to_pylist()) if d is not None)
        self.docs = np.frombuffer(table.column("docs")[head].as_py(), dtype=np.int64)
        self.named = np.frombuffer(table.column("named")[head].as_py(), dtype=np.uint8) > 0
        self.ends = np.frombuffer(table.column("ends")[head].as_py(), dtype=np.int64)
        self.lists = {t: b for t, b in zip(term.tolist(), blobs, strict=True) if b is not None}

    def positions(self, term: int) -> np.ndarray:
        return np.frombuffer(self.lists.get(term, b""), dtype=np.int32)

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Sorted positions where the terms stand in a row."""
        parts = []
        for k, t in enumerate(terms):
            blob = self.lists.get(t)
            if blob is None:
                return np.zeros(0, np.int32)
            parts.append((len(blob), k, blob))
        parts.sort(key=lambda x: x[:2])
        at = np.frombuffer(parts[0][2], dtype=np.int32) - parts[0][1]
        for _, k, blob in parts[1:]:
            other = np.frombuffer(blob, dtype=np.int32)
            near = np.searchsorted(other, at + k)
            at = at[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] == at + k)]
            if not len(at):
                break
        return at[at >= 0]

    def near(self, terms: list[int], distance: int) -> np.ndarray:
        """Positions of a document's rarest term that have every other term within distance, in the same document."""
        parts = [self.positions(t) for t in dict.fromkeys(terms)]
        if not all(map(len, parts)):
            return np.zeros(0, np.int32)
        docs = [np.searchsorted(self.ends, x, side="right") for x in parts]
        rare = np.argmin([np.bincount(d, minlength=len(self.ends)) for d in docs], axis=0)
        at = np.sort(np.concatenate([x[rare[d] == k] for k, (x, d) in enumerate(zip(parts, docs, strict=True))]))
        doc = np.searchsorted(self.ends, at, side="right")
        for other in parts:
            lo = np.maximum(at - distance, np.where(doc > 0, self.ends[doc - 1], 0))
            hi = np.minimum(at + distance, self.ends[doc] - 1)
            ok = np.searchsorted(other, lo) < np.searchsorted(other, hi, side="right")
            at, doc = at[ok], doc[ok]
        return at


def search(index: DataFrame, phrases: dict[int, list[int]], distance: int | None = None) -> DataFrame:
    """(query, doc_id, position): every exact match of term lists, or, with distance, proximity match.

    position counts words of the document from 0.
    """

    def run(group):
        import pyarrow as pa

        block = Block(group)
        out = []
        for q, terms in phrases.items():
            at = block.phrase(terms) if distance is None else block.near(terms, distance)
            doc = np.searchsorted(block.ends, at, side="right")
            start = np.where(doc > 0, block.ends[doc - 1], 0)
            ids = np.where(block.named[doc], block.docs[doc].astype(object), None)
            out += zip([q] * len(at), ids.tolist(), (at - start).tolist(), strict=True)
        q, d, p = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "doc_id": pa.array(d, pa.int64()), "position": pa.array(p, pa.int64())})

    return index.groupBy("block").applyInArrow(run, "query long, doc_id long, position long")


def query_terms(text: str) -> list[int]:
    return c.signed(c.hash_words([text.encode()], c.ALNUM)[0]).tolist()


def windows_of(texts: list[bytes], size: int = WINDOW) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(item number, terms) of every window of size words; a shorter item is one window."""
    for i, t in enumerate(texts):
        w = c.signed(c.hash_words([t], c.ALNUM)[0]).tolist()
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            yield i, tuple(w[k : k + size])


class Windows:
    """The windows of a pass: a row of term numbers each, -1 behind the end of shorter ones."""

    def __init__(self, items: list[list[tuple[int, ...]]], size: int):
        flat = [w for own in items for w in own]
        self.length = np.array([len(w) for w in flat], dtype=np.int64)
        self.item = np.repeat(np.arange(len(items)), [len(own) for own in items])
        self.terms, number = np.unique(np.array([t for w in flat for t in w], dtype=np.int64), return_inverse=True)
        self.matrix = np.full((len(flat), size), -1, dtype=np.int64)
        self.matrix[np.arange(size) < self.length[:, None]] = number


class Bound:
    """Windows held against the postings of one block."""

    def __init__(self, block: Block, windows: Windows):
        self.block, self.windows = block, windows
        lists = [block.positions(t) for t in windows.terms.tolist()]
        self.count = np.array([len(x) for x in lists], dtype=np.int64)
        self.flat = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(lists)), self.count)
        m = windows.matrix
        self.rows = np.flatnonzero(((m < 0) | (self.count[m] > 0)).all(axis=1)) if len(m) else np.zeros(0, np.int64)

    def _candidates(self, rows: np.ndarray):
        """Of rows: their terms from rare to frequent, and each position of the rarest with its row."""
        m = self.windows.matrix[rows]
        order = np.argsort(np.where(m < 0, np.iinfo(np.int64).max, self.count[m]), axis=1, kind="stable")
        rare = m[np.arange(len(rows)), order[:, 0]]
        many = self.count[rare]
        part = (np.cumsum(many) - 1) // CANDIDATES
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            n = many[lo:hi]
            w = np.repeat(np.arange(lo, hi), n)
            yield m, order, w, self.flat[np.repeat(self.first[rare[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact match."""
        total = int(self.block.ends[-1]) if len(self.block.ends) else 0
        size = self.windows.matrix.shape[1]
        there = np.full(total + size, -1, dtype=np.int64)
        there[self.flat] = self.owner
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for m, order, w, at in self._candidates(self.rows):
            at = at - order[w, 0]
            w, at = w[at >= 0], at[at >= 0]
            for j in range(1, size):
                col = order[w, j]
                term = m[w, col]
                ok = (term < 0) | (there[at + col] == term)
                w, at = w[ok], at[ok]
            out.append((self.rows[w], at))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def near(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, document number) of proximity matches."""
        ends, size = self.block.ends, self.windows.matrix.shape[1]
        key = self.owner << 32 | self.flat
        # postings of a term in a document: where they begin in flat, and how many they are
        pair = self.owner << 32 | np.searchsorted(ends, self.flat, side="right")
        pair, begin, many = np.unique(pair, return_index=True, return_counts=True)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for m, order, w, at in self._candidates(self.rows):
            doc = np.searchsorted(ends, at, side="right")
            once = np.append(True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]))[: len(w)]
            w, doc = w[once], doc[once]
            # the document's rarest term of each window: fewest positions, then column
            least, own = np.full(len(w), np.iinfo(np.int64).max), np.zeros(len(w), np.int64)
            for j in range(size):
                col = order[w, j]
                term = m[w, col]
                found = np.minimum(np.searchsorted(pair, np.maximum(term, 0) << 32 | doc), len(pair) - 1)
                ok = (term < 0) | (pair[found] == (term << 32 | doc))
                rank = np.where(term < 0, np.iinfo(np.int64).max, many[found] * size + col)
                own = np.where(rank < least, found, own)[ok]
                w, doc, least = w[ok], doc[ok], np.minimum(least, rank)[ok]
            n = many[own]
            at = self.flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            w, doc = np.repeat(w, n), np.repeat(doc, n)
            lo = np.maximum(at - distance, np.where(doc > 0, ends[doc - 1], 0))
            hi = np.minimum(at + distance, ends[doc] - 1)
            for j in range(size):
                term = m[w, order[w, j]]
                next_ = np.searchsorted(key, np.maximum(term, 0) << 32 | lo)
                ok = (term < 0) | (key[np.minimum(next_, len(key) - 1)] <= (term << 32 | hi)) & (next_ < len(key))
                w, doc, lo, hi = w[ok], doc[ok], lo[ok], hi[ok]
            out.append((self.rows[w], doc))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


SPANS = "array<struct<start: int, end: int>>"
HITS = f"block long, number long, doc_id long, n_words long, n_hit long, items array<string>, near array<string>, spans {SPANS}"


def _hits(items: list[list[tuple[int, ...]]], names: list[str], size: int, near: int | None):
    """Per document of a block: words, words hit, runs of words hit, and items found. items: windows of each."""

    made: list[Windows] = []  # once a task

    def run(group):
        import pyarrow as pa

        if not made:
            made.append(Windows(items, size))
        windows, block = made[0], Block(group)
        bound = Bound(block, windows)
        start = np.concatenate([[0], block.ends[:-1]])
        total = int(block.ends[-1]) if len(block.ends) else 0
        w, at = bound.phrases()
        mark = np.bincount(at, minlength=total + size + 1) - np.bincount(at + windows.length[w], minlength=total + size + 1)
        inside = np.concatenate([[0], np.cumsum(mark)[:total] > 0, [0]]).astype(np.int8)
        hit = np.concatenate([[0], np.cumsum(inside[1:-1])])
        runs = zip(np.flatnonzero(np.diff(inside) == 1).tolist(), np.flatnonzero(np.diff(inside) == -1).tolist(), strict=True)
        rows = len(block.docs)
        spans = [[] for _ in range(rows)]
        for a, b in runs:
            d = int(np.searchsorted(block.ends, a, side="right"))
            spans[d].append({"start": int(a - start[d]), "end": int(b - start[d])})

        def lists(doc, item, without=None):
            out = [[] for _ in range(rows)]
            for d, i in {*zip(doc.tolist(), item.tolist(), strict=True)} - (without or set()):
                if names[i] is not None:
                    out[d].append(names[i])
            return [sorted(x) for x in out]

        exact = np.searchsorted(block.ends, at, side="right"), windows.item[w]
        found = lists(*exact)
        close = [[] for _ in range(rows)]
        if near is not None:
            v, doc = bound.near(near)
            close = lists(doc, windows.item[v], {*zip(exact[0].tolist(), exact[1].tolist(), strict=True)})
        n = block.ends - start - 1
        hits = hit[block.ends - 1] - hit[start] if total else np.zeros(rows, np.int64)
        return pa.table({"block": pa.array(np.full(rows, group.column("block")[0].as_py())), "number": pa.array(np.arange(rows)), "doc_id": pa.array(block.docs, mask=~block.named), "n_words": pa.array(n), "n_hit": pa.array(hits.astype(np.int64)), "items": pa.array(found, pa.list_(pa.string())), "near": pa.array(close, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", near: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near, spans): words inside windows of benchmark items, and those items.

    The benchmark is the query set; it is read in passes of QUERY_ROWS windows, so a large one costs
    more passes over the index and no more memory in a task. spans are runs of hit words, end exclusive. With
    a distance near, the column near names the items that have no exact match but a proximity match.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    passes: list[tuple[list, list]] = [([], [])]
    held = 0
    for r in rows.toLocalIterator():
        own = [w for _, w in windows_of([(r["t"] or "").encode()], window)]
        if held and held + len(own) > QUERY_ROWS:
            passes.append(([], []))
            held = 0
        passes[-1][0].append(own)
        passes[-1][1].append(r["i"])
        held += len(own)
    terms = np.array(sorted({t for items, _ in passes for own in items for w in own for t in w}), dtype=np.int64).view(np.uint64)
    index = build_index(docs, terms)
    out, *rest = [index.groupBy("block").applyInArrow(_hits(items, names, window, near), HITS) for items, names in passes]
    if rest:
        # unite the runs of words that different passes have hit; an item is in one pass
        for p in rest:
            out = out.unionByName(p)
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"), F.from_json(F.lit("[]"), SPANS).alias("out"))

        def step(a, x):
            fresh = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))
            last = F.try_element_at(a["out"], F.lit(-1))
            grown = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
            return F.struct((a["n"] + fresh).alias("n"), F.greatest(a["to"], x["end"]).alias("to"), F.when((F.size(a["out"]) > 0) & (x["start"] <= a["to"]), grown).otherwise(F.concat(a["out"], F.array(x))).alias("out"))

        flat = lambda k: F.array_sort(F.flatten(F.collect_list(k)))
        united = out.groupBy("block", "number", "doc_id").agg(F.max("n_words").alias("n_words"), flat("items").alias("items"), flat("near").alias("near"), F.aggregate(flat("spans"), begin, step).alias("u"))
        out = united.select("doc_id", "n_words", F.col("u.n").cast("long").alias("n_hit"), "items", "near", F.col("u.out").alias("spans"))
    return out.select("doc_id", "n_words", "n_hit", "items", "near", "spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"), near=NEAR)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"))
