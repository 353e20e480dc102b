"""Removal of repeated byte strings by per-shard suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Suffix-sorting whole
corpora against each other costs a comparison of every pair of shards; so shards are made of bytes that
can matter, and put so that equal strings meet:

1. Every window of `length` bytes selects its least k-gram by hash (leftmost on ties). Equal windows
   select the same k-gram at the same place. The windows that select one k-gram are a run; the bytes they
   cover are its context. A text that stands in a task before is not scanned again: copies of a whole
   text of `length` bytes or more go whole.
2. Contexts that are equal byte for byte are one; if it has two places, all its windows repeat. A k-gram
   with a single context needs nothing further. Of the others one context each is shipped.
3. K-grams are dealt to buckets; contexts of a bucket are shards of SHARD bytes. A shard's suffixes are
   sorted by Larsson-Sadakane refinement (ranks of doubling prefixes; only unsorted groups are sorted
   again), Kasai's recurrence gives their common prefixes, and neighbours that share `length` bytes but
   come from different places repeat. Further shards of a bucket are merged by binary search of one's
   distinct windows among the other's. A k-gram with more than HOT bytes of contexts is dealt in blocks, and
   each pair of blocks is a bucket: a task holds HOT bytes at most, whatever the k-gram.
4. Repeated ranges go back to all places of their contexts, are united by document, and are cut out.

The same four steps over lower-cased words instead of bytes find passages of `passage` words or more that stand
in another document too, whatever their bytes and white space: shared lists their ranges of words. Nothing
is cut for them, as 51 words can be fewer than `length` bytes.

Null texts are empty. Texts shorter than `length` keep everything. Repeated rows are copies of each
other, so long ones go whole; a doc_id that is not null must name one text. Rows with a null doc_id are told
apart by their texts and keep the null in the result. Matches never cross documents. An empty table gives an empty result. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LENGTH, GRAM = 400, 32
#: Words of a shared passage, and of its k-grams: over 50 words.
PASSAGE, PASSAGE_GRAM = 51, 6
SHARD = 500_000
#: Bytes of contexts of one k-gram that go to one bucket.
HOT = 8_000_000
#: Alignments of a window on its k-gram that are told apart before contexts are sorted.
ALIGNED = 16
#: Contexts to fetch, or ranges to cut, up to this number are broadcast (about 40 bytes each); more are
#: joined by shuffle.
BROADCAST_ROWS = 1_000_000

_U = np.uint64


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data (bytes, or words as 64-bit numbers) in order of their first depth items, ties by position.

    Larsson-Sadakane: ranks of prefixes of h items give those of 2h; groups that are single are left.
    The end of data sorts before every item.
    """
    n = len(data)
    if data.dtype == np.uint8:
        h = 7  # nine bits a byte: seven bytes
        padded = np.concatenate([data.astype(np.uint64) + _U(1), np.zeros(7, np.uint64)])
        key = np.zeros(n, dtype=_U)
        for j in range(h):
            key = key << _U(9) | padded[j : j + n]
    else:
        h, key = 1, data
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while h < depth:
        step = min(h, depth - h)  # the last step overlaps
        last = np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            break
        at = sa[open_]
        pair = rank[at] * _I + rank[np.minimum(at + step, n)] + 1
        order = np.argsort(pair, kind="stable")
        sa[open_] = at[order]
        pair = pair[order]
        split = np.concatenate([[True], pair[1:] != pair[:-1]])
        first[open_] = split
        rank[sa[open_]] = open_[np.maximum.accumulate(np.where(split, np.arange(len(open_)), 0))]
        h += step
    return sa


_I = 1 << 31


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, stride: int = 16) -> np.ndarray:
    """Items (up to limit) that each suffix shares with the one before it in sa.

    Kasai's recurrence in text order, for every stride-th position at once: a suffix shares at least one
    byte less with its neighbour than the suffix before it did. As sa is sorted to a depth only, the
    promise is checked by hashes before it is built upon.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    prefix = c.prefix_hash(data)
    word = np.zeros(n + 1, dtype=_U)
    many = 8 if data.dtype == np.uint8 else 1  # items that are compared at once
    if many == 8:
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        for j in range(8):
            word[:n] |= wide[j : j + n].astype(_U) << _U(8 * j)
    else:
        word[:n] = data
    out = np.zeros(n + 1, dtype=np.int64)
    for j in range(stride):
        i = np.arange(j, n, stride)
        i = i[before[i] >= 0]
        b = before[i]
        room = np.minimum(n - np.maximum(i, b), limit)
        h = np.minimum(np.maximum(out[i - 1] - 1, 0), room) if j else np.zeros(len(i), np.int64)
        h = np.where(c.span_hash(prefix, i, i + h) == c.span_hash(prefix, b, b + h), h, 0)
        live = np.flatnonzero(h < room)
        while len(live):
            x = word[i[live] + h[live]] ^ word[b[live] + h[live]]
            low = x & (~x + _U(1))
            same = np.where(x == 0, many, np.log2(np.maximum(low, _U(1)).astype(np.float64)).astype(np.int64) // 8 if many == 8 else 0)
            h[live] = np.minimum(h[live] + same, room[live])
            live = live[(same == many) & (h[live] < room[live])]
        out[i] = h
    return out[sa]


class Shard:
    """Contexts side by side; windows lists the starts of windows, place their origin.

    With apart, all windows of a context have its place, so windows of equal places do not repeat each other.
    """

    def __init__(self, blobs: list[bytes], places: list[int], length: int, kind: type = np.uint8, apart: bool = False):
        self.length = length
        self.data = np.frombuffer(b"".join(blobs), dtype=kind)
        sizes = np.array([len(b) // self.data.itemsize for b in blobs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        many = sizes - length + 1
        off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.windows = np.repeat(starts, many) + off
        self.place = np.repeat(np.array(places, dtype=np.int64), many) + (0 if apart else off)
        self.repeated = np.zeros(len(self.windows), dtype=bool)
        number = np.full(len(self.data), -1, dtype=np.int64)
        number[self.windows] = np.arange(len(self.windows))
        sa = suffix_array(self.data, length)
        lcp = common_prefixes(self.data, sa, length)
        # windows in suffix order; the common prefix with the window before is the least in between
        group = np.cumsum(lcp < length)
        mine = number[sa] >= 0
        self.order, self.group = number[sa[mine]], group[mine]
        first = np.concatenate([[True], self.group[1:] != self.group[:-1]]) if len(self.order) else np.zeros(0, bool)
        head = np.flatnonzero(first)
        self.head = head
        if len(head):
            p = self.place[self.order]
            differ = np.minimum.reduceat(p, head) != np.maximum.reduceat(p, head)
            self.repeated[self.order] = np.repeat(differ, np.diff(np.append(head, len(p))))
            self.least = np.minimum.reduceat(p, head)

    def window(self, k: np.ndarray) -> np.ndarray:
        """Starts of the distinct windows number k, in sorted order."""
        return self.windows[self.order[self.head[k]]]

    def mark(self, k: np.ndarray) -> None:
        ends = np.append(self.head, len(self.order))
        for x in k.tolist():
            self.repeated[self.order[ends[x] : ends[x + 1]]] = True

    def merge(self, other: Shard) -> None:
        """Marks what the shards share, by binary search of our distinct windows among the other's."""
        if not len(self.head) or not len(other.head):
            return
        mine = self.window(np.arange(len(self.head)))
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(other.head), dtype=np.int64)
        equal = np.full(len(mine), -1, dtype=np.int64)
        live = np.arange(len(mine))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            sign = self._compare(mine[live], other, other.window(mid))
            equal[live[sign == 0]] = mid[sign == 0]
            lo[live[sign > 0]] = mid[sign > 0] + 1
            hi[live[sign < 0]] = mid[sign < 0]
            live = live[(sign != 0) & (lo[live] < hi[live])]
        hit = np.flatnonzero(equal >= 0)
        to = equal[hit]
        differ = (self.least[hit] != other.least[to]) | self.repeated[self.order[self.head[hit]]] | other.repeated[other.order[other.head[to]]]
        self.mark(hit[differ])
        other.mark(to[differ])

    def _compare(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        sign = np.zeros(len(a), dtype=np.int8)
        live, step = np.arange(len(a)), 0
        while len(live) and step < self.length:
            width = min(16, self.length - step)
            x = self.data[a[live][:, None] + np.arange(step, step + width)]
            y = other.data[b[live][:, None] + np.arange(step, step + width)]
            row, k = np.arange(len(x)), (x != y).argmax(axis=1)
            u, v = x[row, k], y[row, k]
            sign[live] = (u > v).astype(np.int8) - (u < v)
            live, step = live[u == v], step + width
        return sign


# ---------------------------------------------------------------- the operator


ANCHORS = "kind int, doc_id long, n long, h1 long, h2 long, a long, ctx long, pos int, l int, r int"


def items_of(texts: list[bytes], words: bool) -> list[np.ndarray]:
    """The bytes of each text, or the hashes of its lower-cased words."""
    if not words:
        return [np.frombuffer(t, dtype=np.uint8) for t in texts]
    hashes, at = c.hash_words(texts, c.SPACED)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _anchors(length: int, gram: int, words: bool):
    """Rows of documents (kind 0) and of the runs of windows that select one k-gram (kind 1)."""
    span = length - gram + 1

    def runs(texts: list[np.ndarray]):
        data = np.concatenate(texts)
        n = len(data)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        prefix = c.prefix_hash(data)
        k = n - gram + 1
        if k < span:
            return None
        raw = (prefix[gram:] - prefix[:-gram]) * c.powers(c._INVERSE, n + 1)[:k]
        order = ((raw * _U(0xD6E8FEB86659FD93)) >> _U(32)) << _U(32) | np.arange(k, dtype=_U)
        full = np.full(-(-k // span) * span, np.iinfo(np.uint64).max, dtype=_U)
        full[:k] = order
        table = full.reshape(-1, span)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = k - span + 1
        least = np.minimum(back[:starts], ahead[span - 1 : span - 1 + starts])
        chosen = (least & _U(0xFFFFFFFF)).astype(np.int64)
        many = np.maximum(sizes - length + 1, 0)
        base = ends - sizes
        window = np.arange(many.sum()) + np.repeat(base - (np.cumsum(many) - many), many)
        if not len(window):
            return None
        p = chosen[window]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1)]))
        s, e = window[new], window[np.append(new[1:], len(window)) - 1] + length
        p = p[new]
        doc = np.searchsorted(ends, s, side="right")
        a = c.mix(raw[p])
        ctx = c.mix(c.span_hash(prefix, s, e) + (p - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        return doc, a, ctx, p - base[doc], p - s, e - p

    def run(batches):
        import pyarrow as pa

        done: set[tuple[int, int]] = set()
        for batch in c.slices(batches, 1):
            ids, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), c.texts_of(batch.column(1))
            for lo, hi in c.pieces(texts):
                own = items_of(texts[lo:hi], words)
                marks = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in own]
                h = np.frombuffer(b"".join(marks), dtype=np.int64).reshape(-1, 2)
                fresh = []
                for i, m in enumerate(marks):
                    if len(own[i]) >= length and m not in done:
                        done.add(m)
                        fresh.append(i)
                rows = len(own)
                zero = np.zeros(rows, np.int64)
                z32 = zero.astype(np.int32)
                yield _batch(pa, z32, ids[lo:hi], np.array([len(t) for t in own]), h[:, 0], h[:, 1], zero, zero, z32, z32, z32)
                got = runs([own[i] for i in fresh]) if fresh else None
                if got is not None:
                    doc, a, ctx, pos, left, right = got
                    zero = np.zeros(len(doc), np.int64)
                    yield _batch(pa, np.ones(len(doc), np.int32), ids[lo:hi][np.array(fresh)[doc]], zero, zero, zero, c.signed(a), c.signed(ctx), pos.astype(np.int32), left.astype(np.int32), right.astype(np.int32))

    return run


def _batch(pa, *columns):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=[x.split()[0] for x in ANCHORS.split(", ")])


CONTEXTS = "bucket long, a long, ctx long, doc_id long, pos int, l int, full boolean, bytes binary"


def _contexts(words: bool, buckets: int):
    """Cuts the wanted contexts out of texts; a k-gram has a bucket by its hash, or pairs of blocks."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        for batch in c.slices(batches, 1):
            ids, texts, asked = batch.column(0).to_pylist(), c.texts_of(batch.column(1)), batch.column(2).to_pylist()
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for lo, hi in c.pieces(texts):
                for i, t, wanted in zip(ids[lo:hi], items_of(texts[lo:hi], words), asked[lo:hi], strict=True):
                    for w in wanted:
                        blob = t[w["pos"] - w["l"] : w["pos"] + w["r"]].tobytes()
                        for bucket in w["pairs"] or (w["a"] % buckets,):
                            for k, v in zip(names, (bucket, w["a"], w["ctx"], i, w["pos"], w["l"], w["full"], blob), strict=True):
                                out[k].append(v)
                            held += len(blob)
                    if held > 8_000_000:
                        yield _made(pa, out)
                        out, held = {k: [] for k in out}, 0
            yield _made(pa, out)

    return run


def _made(pa, out):
    kinds = {"pos": pa.int32(), "l": pa.int32(), "full": pa.bool_(), "bytes": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def alike(blobs: list[bytes], a: np.ndarray, left: np.ndarray, length: int, gram: int, kind: type = np.uint8) -> np.ndarray:
    """Numbers of the contexts that may share a window with another of their k-gram (a, left items into the context).

    Equal windows have their k-gram at the same place, so they agree on one of ALIGNED blocks that surround it. The
    hash of each block that a context holds is taken; a context whose blocks are all its own shares no window.
    """
    data = np.frombuffer(b"".join(blobs), dtype=kind)
    ends = np.cumsum([len(b) // data.itemsize for b in blobs])
    starts = np.concatenate([[0], ends[:-1]])
    prefix, at = c.prefix_hash(data), starts + left
    width = -(-(length - gram) // ALIGNED)
    kept = np.zeros(len(blobs), dtype=bool)
    for g in range(ALIGNED):
        lo, hi = at - g * width, at - (g + 1) * width + length
        own = np.flatnonzero((lo >= starts) & (hi <= ends))
        key = c.span_hash(prefix, lo[own], hi[own]) ^ a[own].view(_U)
        _, number, many = np.unique(key, return_inverse=True, return_counts=True)
        kept[own[many[number] > 1]] = True
    return np.flatnonzero(kept)


def _match(length: int, gram: int, shard_bytes: int, words: bool):
    """Per bucket: ranges of contexts that repeat elsewhere, relative to the k-gram.

    Of words, elsewhere is another document; a context that two documents have is in a place of its own.
    """
    kind = np.uint64 if words else np.uint8

    def run(group):
        import pyarrow as pa

        rows = group.sort_by([("a", "ascending"), ("ctx", "ascending")])
        a, ctx, doc, pos, left = (rows.column(k).to_numpy() for k in ("a", "ctx", "doc_id", "pos", "l"))
        blobs = rows.column("bytes").to_pylist()
        docs = np.unique(doc, return_inverse=True)[1]
        places = (docs.astype(np.int64) << 34) + pos - left
        if words:
            full = rows.column("full").to_numpy()
            places = np.where(full, -1 - np.arange(len(docs)), docs)
        shards: list[tuple[list[int], Shard]] = []
        held, own = 0, []
        for i in [*alike(blobs, a, left, length, gram, kind).tolist(), len(blobs)]:
            if own and (i == len(blobs) or held + len(blobs[i]) > shard_bytes):
                shard = Shard([blobs[j] for j in own], [int(places[j]) for j in own], length, kind, words)
                for _, before in shards:
                    shard.merge(before)
                shards.append((own, shard))
                own, held = [], 0
            if i < len(blobs):
                own.append(i)
                held += len(blobs[i])
        out = {k: [] for k in ("a", "ctx", "s", "e")}
        for own, shard in shards:
            at = 0
            for i in own:
                many = len(blobs[i]) // np.dtype(kind).itemsize - length + 1
                hit = np.concatenate([[0], shard.repeated[at : at + many], [0]]).astype(np.int8)
                at += many
                change = np.diff(hit)
                for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
                    for k, v in zip(out, (int(a[i]), int(ctx[i]), s - int(left[i]), e - 1 + length - int(left[i])), strict=True):
                        out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _cut(batches):
    """Applies ranges to texts."""
    import pyarrow as pa

    for batch in c.slices(batches, 1):
        ids, texts, ranges = batch.column(0).to_pylist(), c.texts_of(batch.column(1)), batch.column(2).to_pylist()
        removed, spans, digest, kept = [], [], [], []
        for t, rs in zip(texts, ranges, strict=True):
            at, gone, many, parts = 0, 0, 0, []
            last = -1
            for s, e in sorted((r["s"], r["e"]) for r in rs or ()):
                if s > last:
                    many += 1
                if e > last:
                    parts.append(t[at:s] if s > at else b"")
                    gone += e - max(s, max(last, 0))
                    at = last = e
            parts.append(t[at:])
            rest = b"".join(parts)
            removed.append(gone), spans.append(many), digest.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
        more = {"shared": batch.column(3)} if batch.num_columns > 3 else {}
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary())} | more)


def _united(ranges):
    """Ranges in order, those that touch or overlap as one."""
    kind = "array<struct<s:bigint,e:bigint>>"
    begin = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"), F.from_json(F.lit("[]"), kind).alias("out"))
    flush = lambda a: F.when(a["e"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    def step(a, x):
        grown = F.struct(a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"), a["out"].alias("out"))
        return F.when(x["s"] <= a["e"], grown).otherwise(F.struct(x["s"].alias("s"), x["e"].alias("e"), flush(a).alias("out")))

    return F.aggregate(F.array_sort(ranges), begin, step, flush)


def repeated_ranges(own: DataFrame, length: int, gram: int, shard: int, words: bool = False) -> DataFrame:
    """(doc_id, ranges): ranges of items (s, e) of own (doc_id, text) that windows of length items cover which
    stand elsewhere too; of words, in another document."""
    item = 8 if words else 1
    scanned = c.materialise(own.mapInArrow(_anchors(length, gram, words), ANCHORS), "anchors")
    whole = scanned.where("kind = 0").select("doc_id", "n", "h1", "h2").where(F.col("n") >= length)
    copies = whole.groupBy("h1", "h2", "n").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2", "n")
    ranges = whole.join(copies, ["h1", "h2", "n"], "left_semi").select("doc_id", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))

    runs = scanned.where("kind = 1").select("doc_id", "a", "ctx", "pos", "l", "r")
    place = F.struct("doc_id", "pos", "l", "r")
    twice = F.col("lo.doc_id") != F.col("hi.doc_id")
    twice = twice if words else twice | (F.col("lo.pos") != F.col("hi.pos"))
    groups = c.materialise(runs.groupBy("a", "ctx").agg(F.min(place).alias("lo"), F.max(F.struct("doc_id", "pos")).alias("hi")).select("a", "ctx", "lo", twice.alias("full")), "contexts")
    full = groups.where("full").select("a", "ctx")
    several = groups.groupBy("a").agg(F.count("*").alias("m"), F.min("full").alias("all_full"), F.sum((F.col("lo.l") + F.col("lo.r")) * item).alias("w")).where("m > 1 and not all_full").select("a", "w")
    wanted = c.materialise(groups.join(several, "a").select("a", "ctx", "lo.doc_id", "lo.pos", "lo.l", "lo.r", "full", "w"), "wanted")
    size = wanted.agg(F.sum(F.col("l") + F.col("r")).alias("b"), F.count("*").alias("m")).collect()[0]
    buckets = max(1, -(-(size["b"] or 0) * item // shard))
    # a hot k-gram: blocks of half of HOT, and a bucket for each pair of them
    blocks = F.ceil(F.col("w") * 2 / F.lit(HOT))
    mine = F.pmod(F.xxhash64("ctx"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: -1 - F.pmod(F.xxhash64("a", F.least(mine, j), F.greatest(mine, j)), F.lit(1 << 40)))
    asked = wanted.withColumn("pairs", F.when(F.col("w") > HOT, pairs)).groupBy("doc_id").agg(F.collect_list(F.struct("pairs", "a", "ctx", "pos", "l", "r", "full")).alias("w"))
    few = size["m"] <= BROADCAST_ROWS
    cut = own.join(F.broadcast(asked) if few else asked, "doc_id").select("doc_id", "text", "w").mapInArrow(_contexts(words, buckets), CONTEXTS)
    partial = c.materialise(cut.groupBy("bucket").applyInArrow(_match(length, gram, shard, words), "a long, ctx long, s long, e long"), "matched")
    ranges = ranges.union(runs.join(full, ["a", "ctx"], "left_semi").select("doc_id", (F.col("pos") - F.col("l")).cast("long"), (F.col("pos") + F.col("r")).cast("long")))
    ranges = ranges.union(runs.join(partial, ["a", "ctx"]).select("doc_id", F.col("pos") + F.col("s"), F.col("pos") + F.col("e")))
    return c.materialise(ranges.groupBy("doc_id").agg(_united(F.collect_set(F.struct("s", "e"))).alias("ranges")), "ranges")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; kept are the bytes left.

    With passage, also n_shared_words and shared: the words, and ranges of words, in passages of that many
    words or more that stand in another document too.
    """
    own = docs.select(F.col(id_col).cast("long").alias("given"), c.row_key(id_col, text_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = own.select("doc_id", "text")
    found = [repeated_ranges(keyed, length, gram, shard)]
    if passage:
        found.append(repeated_ranges(keyed, passage, passage_gram, shard, True).withColumnRenamed("ranges", "shared"))
    out = own
    for f in found:
        few = (f.agg(F.sum(F.size(f.columns[1]))).collect()[0][0] or 0) <= BROADCAST_ROWS
        out = out.join(F.broadcast(f) if few else f, "doc_id", "left")
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if not passage:
        return out.select("given", "text", "ranges").mapInArrow(_cut, kept)
    shared = "shared array<struct<s: bigint, e: bigint>>"
    words = F.aggregate(F.coalesce("shared", F.from_json(F.lit("[]"), shared.partition(" ")[2])), F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("given", "text", "ranges", "shared").mapInArrow(_cut, f"{kept}, {shared}").withColumn("n_shared_words", words)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(c.table(spark, sf_dir, "documents"), passage=PASSAGE).drop("kept", "shared")
