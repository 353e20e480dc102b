"""Exact n-gram Jaccard join by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric, so everything below is exact for d <= r:

1. Equal shingle sets are one class; only one text of a class goes on.
2. First pivots are single shingles. d(x, {s}) is 1 - 1/|x| for a shingle of x and 1 otherwise, so x
   lies in the Voronoi region of each of its shingles and an order of the pivots breaks the tie. The
   triangle inequality bounds how far past its own region a set must be replicated: two sets within r
   differ in few elements, hence share one of their first |x| - ceil((1 - r)|x|) + 1 pivots. Classes
   that never share such a region are further apart than r; the rest fall into islands, the
   connected components of shared regions. Rare shingles come first in the order, so a passage that
   many documents quote does not tie them together.
   This step is a prefix filter seen as pivots: it proves most pairs apart, and pairs that it leaves are only
   kept where the sums of their counters leave room for a link; real documents are pivots from step 3 on.
3. Islands with more shingles than `cap`, or more than MEMBERS documents, are split over the cluster: several documents of the island
   are pivots; every member goes to its nearest one if that is within r (its core, linked at once);
   members with r < d(y, p) <= 2r are replicated into p's region, since d(x, p) <= r and d(x, y) <= r
   give d(y, p) <= 2r; a core is cut into blocks; members in no core recurse with new pivots.
4. Islands and regions of up to `cap` shingles and MEMBERS documents are joined by the same rule inside one
   task, whose work is at most MEMBERS passes over `cap` shingles.

Sets are held as 64-bit hashes of shingles: two different shingles agree with probability 2**-64.

Null, empty and wordless texts have no shingles and link with nothing. Texts of fewer than n words
are one shingle, the whole sequence. Very long texts are read whole, in slices of their own. Ties between
pivots go to the rarer counter, then the lesser hash. Repeated rows (same doc_id and text) act as one document; different
texts under one doc_id link each for itself. A text whose rows all have a null doc_id has no name: it links with nothing and its
component is null; a copy of a named text shares that one's component. An empty table
gives an empty result. Further columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

N_WORDS, NUM, DEN = 5, 80, 100
#: Shingles (8 bytes each) that one task may hold as one region.
CAP = 8_000_000
#: The table of shingle frequencies has this many counters, whatever the input.
COUNTERS = 1 << 18
#: (doc_id, region) pairs up to this number are broadcast (16 bytes each); more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Documents that one task may hold as one region.
MEMBERS = 8192
PIVOTS = 8
#: Least and largest number of counters of the contracted space, a byte each.
DIMS = (64, 8192)
#: Larger regions go whole into one island, to be split by pivots in step 3.
WIDE = 2048
MAX_SPLITS = 12


def shingle_sets(texts: list[bytes], n: int = N_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in c.pieces(texts):
        words, at = c.hash_words(texts[lo:hi], c.SPACED)
        k = max(len(words) - n + 1, 0)
        grams = np.zeros(k, dtype=np.uint64)
        for j in range(n):
            grams += words[j : j + k] * c.powers(0xA0761D6478BD642F, n)[j] if j else words[:k]
        grams = c.mix(grams)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                short = int(b - a)
                yield c.mix(np.array([short], dtype=np.uint64) + np.sum(words[a:b] * c.powers(0xE7037ED1A0B428DB, n)[:short], keepdims=True))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return tuple(int(x) for x in c.signed(np.array([s.sum(dtype=np.uint64), c.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])))


def contract(s: np.ndarray) -> bytes:
    """Counters of a set by hash; halving their number by adding them up is what fewer counters hold."""
    dims = min(max(DIMS[0], 1 << max(len(s) // 8 - 1, 0).bit_length()), DIMS[1])
    return np.minimum(np.bincount((s & np.uint64(dims - 1)).astype(np.int64), minlength=dims), 255).astype(np.uint8).tobytes()


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def _scanned(pa, kind: int, ids, n: list[int], s1: list[int], s2: list[int], cls: list[int], v: list[bytes | None]):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, *(pa.array(x, pa.int64()) for x in (n, s1, s2, cls)), pa.array(v, pa.binary())], names=["kind", "doc_id", "n", "s1", "s2", "cls", "v"])


def _scan(n: int):
    """Per document its set size and signature; per task the counters of shingles seen again."""

    def run(batches):
        import pyarrow as pa

        none = np.zeros(0, np.uint64)
        for batch in batches:
            seen = []
            for part in c.slices([batch], 1):
                sets = list(shingle_sets(c.texts_of(part.column(1)), n))
                marks, size = [signature(s) for s in sets], [len(s) for s in sets]
                seen += sets
                names = [class_hash(k, *m) for k, m in zip(size, marks, strict=True)]
                yield _scanned(pa, 0, part.column(0), size, [m[0] for m in marks], [m[1] for m in marks], names, [contract(s) for s in sets])
            del sets
            every = np.concatenate([none, *seen])
            seen.clear()
            every.sort()
            same = every[1:] == every[:-1]
            # a shingle in m > 1 sets has m - 1 equal neighbours, the first of which has none before it
            start = same.copy()
            start[1:] &= ~same[:-1]
            counts = sum(np.bincount(_bucket(every[1:][x]), minlength=COUNTERS) for x in (same, start))
            hot = np.flatnonzero(counts)
            yield _scanned(pa, 1, pa.array(hot, pa.int64()), counts[hot].tolist(), *[[0] * len(hot)] * 3, [None] * len(hot))
        c.release()

    return run


def _prefixes(n: int, num: int, den: int, counters: np.ndarray):
    """(key, class) for the first pivots of each set, rarest first; one document of a class per task."""

    def run(batches):
        import pyarrow as pa

        done: set[int] = set()
        for batch in c.slices(batches, 0):
            keys, owners = [], []
            for s in shingle_sets(c.texts_of(batch.column(0)), n):
                if not len(s):
                    continue
                cls = class_hash(len(s), *signature(s))
                if cls in done:
                    continue
                done.add(cls)
                take = len(s) - -(-num * len(s) // den) + 1
                rank = counters[_bucket(s)]
                if rank.any():
                    s = s[np.argsort(rank, kind="stable")]
                keys.append(s[:take])
                owners.append(np.full(take, cls, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(np.concatenate(keys))), pa.array(np.concatenate(owners))], names=["key", "cls"])

    return run


def _runs(group):
    """A task over rows sorted by their first column: group(rows of whole runs), batch by batch."""

    def run(batches):
        import pyarrow as pa

        held, state = None, {}
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = t.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            held = t.slice(last)
            if last:
                yield from group(pa, t.slice(0, last), state)
        if held is not None and len(held):
            yield from group(pa, held, state)
        c.release()

    return run


def _starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _regions(pa, t, state):
    """Of rows (key, cls): each set of members once a task, as (gid, cls)."""
    done = state.setdefault("done", set())
    if len(done) > 1_000_000:
        done.clear()
    key, cls = t.column(0).to_numpy(), t.column(1).to_numpy()
    at = _starts(key)
    gids, out = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = cls[lo:hi]
        own = np.unique(own) if hi - lo > 2 else np.array([min(own), max(own)])
        name = hash(own.tobytes())
        if name not in done:
            done.add(name)
            gids.append(np.full(len(own), c.signed(c.mix(own.view(np.uint64)).sum(dtype=np.uint64, keepdims=True))[0]))
            out.append(own)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gids)), pa.array(np.concatenate(out))], names=["gid", "cls"])


def _neighbours(num: int, den: int):
    """Of rows (gid, cls, n, v): edges that connect what may be within r in a region."""

    def fold(v: np.ndarray, dims: int) -> np.ndarray:
        return v.astype(np.int32).reshape(-1, dims).sum(axis=0)

    def group(pa, t, state):
        gid, cls, n = (t.column(k).to_numpy() for k in ("gid", "cls", "n"))
        v = [np.frombuffer(b, dtype=np.uint8) for b in t.column("v").to_pylist()]
        at = _starts(gid)
        got: set[tuple[int, int]] = set()
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = sorted(range(lo, hi), key=lambda i: (n[i], cls[i]))
            size = n[own]
            root = np.arange(len(own))
            levels: dict[int, np.ndarray] = {}
            for k, x in enumerate(own):
                end = np.searchsorted(size, size[k] * den // num, side="right")
                rest = np.flatnonzero(root[k + 1 : end] != root[k]) + k + 1
                if not len(rest):
                    continue
                dims = len(v[x])
                if dims not in levels:
                    levels[dims] = np.array([fold(v[y], dims) if len(v[y]) >= dims else np.zeros(dims, np.int32) for y in own])
                m = levels[dims]
                apart = np.abs(m[rest] - m[k]).sum(axis=1)
                for y in rest[apart * (num + den) <= (size[rest] + size[k]) * (den - num)]:
                    if root[y] != root[k]:
                        got.add((int(cls[x]), int(cls[own[y]])))
                        root[root == root[y]] = root[k]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    return group


def class_hash(size: int, s1: int, s2: int) -> int:
    x = (s1 * 0x9E3779B97F4A7C15 + s2 * 0xC2B2AE3D27D4EB4F + size * 0x165667B19E3779F9) & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _sets(n: int):
    """The sets of (id, text, region), where id is the class of the text; other texts of the same doc_id go."""

    def run(batches):
        import pyarrow as pa

        for batch in c.slices(batches, 1):
            sets = list(shingle_sets(c.texts_of(batch.column(1)), n))
            own = [class_hash(len(s), *signature(s)) & ID_BITS == i for s, i in zip(sets, batch.column(0).to_pylist(), strict=True)]
            batch, blobs = batch.filter(pa.array(own, pa.bool_())), [s.tobytes() for s, x in zip(sets, own, strict=True) if x]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([len(b) // 8 for b in blobs], pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.int64())], names=["region", "id", "n", "elems", "core"])

    return run


ID_BITS = (1 << 63) - 1
SETS = "region long, id long, n long, elems binary, core long"


def _close(inter: np.ndarray, a: np.ndarray, b: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether d <= r, and whether d <= 2r, in integers."""
    union = a + b - inter
    return den * inter >= num * union, den * inter >= (2 * num - den) * union


def join_region(ids: np.ndarray, sets: list[np.ndarray], core: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect, among members of one region, exactly what the links connect.

    core: the pivot whose core a member is in already, or -1. Members of one core are known to be
    connected; core members of a region from step 3 are all of the same pivot.
    """
    m = len(ids)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    known, dense = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    flags = np.zeros(len(known) + 1, dtype=np.int32)
    root = np.arange(m)
    if (core >= 0).any():
        root[core >= 0] = np.flatnonzero(core >= 0)[0]
    edges: list[tuple[int, int]] = []

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[rows]
        off = np.concatenate([[0], np.cumsum(n)])
        return dense[np.repeat(at[rows] - off[:-1], n) + np.arange(off[-1])], off[:-1]

    def overlap(p: int, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own = dense[at[p] : at[p + 1]]
        flags[own] = 1
        out = np.add.reduceat(flags[of[0]], of[1])
        flags[own] = 0
        return out

    def link(p: int, rows: np.ndarray) -> None:
        for x in rows[np.unique(root[rows], return_index=True)[1]] if len(rows) else ():
            if root[x] != root[p]:
                edges.append((int(ids[p]), int(ids[x])))
                lo, hi = sorted((root[x], root[p]))
                root[root == hi] = lo

    left = np.lexsort((ids, c.mix(ids.astype(np.uint64))))
    while len(left) > 1 and (root[left] != root[left[0]]).any():
        pivots, parts = left[:PIVOTS], gather(left)
        shared = np.array([overlap(p, parts) for p in pivots])
        near = [_close(shared[k], size[left], size[p], num, den) for k, p in enumerate(pivots)]
        for k, p in enumerate(pivots):
            link(p, left[near[k][0]])
        dist = 1 - shared / (size[left] + size[pivots][:, None] - shared)
        home = dist.argmin(axis=0)
        cored = np.array([n[0] for n in near]).any(axis=0)
        for k, p in enumerate(pivots):
            own = left[cored & (home == k)]
            window = left[near[k][1] & ~near[k][0]]
            window = window[root[window] != root[p]]
            if len(window) and len(own):
                parts = gather(own)
                for y in window:
                    if root[y] != root[p]:
                        link(y, own[_close(overlap(y, parts), size[own], size[y], num, den)[0]])
        left = left[~cored]
    return edges


def _join_group(num: int, den: int):
    def run(group):
        import pyarrow as pa

        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        sets = [np.frombuffer(b, dtype=np.uint64) for b in group.column("elems").to_pylist()]
        core = group.column("core").fill_null(-1).to_numpy()
        order = np.lexsort((n, ids))
        got = join_region(ids[order], [sets[i] for i in order], core[order], num, den)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return run


def _split(num: int, den: int, block: int):
    """One round of step 3 for a batch of (region, id, n, elems, pivots)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {k: [] for k in ("region", "id", "n", "elems", "core", "a", "b")}

            def put(region, i, n, blob, core, a, b, out=out):
                for k, v in zip(out, (region, i, n, blob, core, a, b), strict=True):
                    out[k].append(v)

            for region, i, n, blob, pivots in zip(*(batch.column(k).to_pylist() for k in ("region", "id", "n", "elems", "pivots")), strict=True):
                s = np.frombuffer(blob, dtype=np.uint64)
                best, where = None, []
                for p in sorted(pivots, key=lambda x: x["id"]):
                    t = np.frombuffer(p["elems"], dtype=np.uint64)
                    inter = len(np.intersect1d(s, t, assume_unique=True))
                    linked, window = (bool(x[0]) for x in _close(np.array([inter]), np.array([len(s)]), len(t), num, den))
                    d = 1 - inter / (len(s) + len(t) - inter)
                    if linked:
                        put(None, None, None, None, None, i, p["id"])
                        best = min(best or (2.0, 0), (d, p["id"]))
                    elif window:
                        where.append(p["id"])
                for p in where:
                    put(_name(region, p, -1), i, n, blob, p, None, None)
                if best is None:
                    put(_name(region, -1, -1), i, n, blob, None, None, None)
                else:
                    put(_name(region, best[1], -1), i, n, blob, -2, int(c.mix(np.array([i], dtype=np.uint64))[0] >> np.uint64(1)), None)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "elems" else pa.int64()) for k, v in out.items()})

    return run


def _name(*parts: int) -> int:
    return int(c.signed(c.mix(np.array([sum((p & (1 << 64) - 1) * k for p, k in zip(parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True)) & (1 << 64) - 1], dtype=np.uint64)))[0])


def _too_large(cap: int):
    return (F.col("w") > cap) | (F.col("m") > MEMBERS)


def _split_large(large: DataFrame, num: int, den: int, cap: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Step 3: edges, and regions of up to cap shingles. large: SETS of too large regions."""
    edges, small = [], []
    for turn in range(MAX_SPLITS):
        slot = F.xxhash64("id", F.lit(turn))
        # at most PIVOTS a region, by map-side minima
        chosen = large.groupBy("region", F.pmod(slot, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(slot.alias("h"), "id")).alias("x")).select("region", F.col("x.id").alias("id"))
        pivots = large.join(chosen, ["region", "id"], "left_semi").groupBy("region").agg(F.collect_list(F.struct("id", "elems")).alias("pivots"))
        made = c.materialise(large.join(pivots, "region").select("region", "id", "n", "elems", "pivots").mapInArrow(_split(num, den, cap), f"{SETS}, a long, b long"), "split")
        edges.append(made.where("region is null").select("a", "b"))
        rows = made.where("region is not null")
        cores, windows, far = rows.where("core = -2"), rows.where("core >= 0"), rows.where("core is null")
        # a core matters only where somebody lies in its window; it is cut into blocks of half the cap
        w = windows.groupBy("region").agg(F.sum("n").alias("w"))
        blocks = cores.groupBy("region").agg(F.sum("n").alias("s")).join(w, "region").withColumn("blocks", F.ceil(F.col("s") * 2 / F.lit(cap)))
        wide = F.expr("ceil(w * 2 / %d)" % cap)
        plan = blocks.select("region", "blocks", wide.alias("wides"))
        part = lambda kind, b, v: F.xxhash64("region", F.lit(kind), b, v)
        own = cores.join(plan, "region").withColumn("i", F.pmod("a", "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wides") - 1)))
        by = windows.join(plan, "region").withColumn("j", F.pmod(F.xxhash64("id"), "wides")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        small.append(own.select(part("c", F.col("i"), F.col("j")).alias("region"), "id", "n", "elems", F.lit(0).cast("long").alias("core")).unionByName(by.select(part("c", F.col("i"), F.col("j")).alias("region"), "id", "n", "elems", F.lit(None).cast("long").alias("core"))))
        far = far.select("region", "id", "n", "elems", "core")
        weight = far.groupBy("region").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
        small.append(far.join(weight.where(~_too_large(cap)), "region", "left_semi"))
        large = far.join(weight.where(_too_large(cap)), "region", "left_semi")
        if large.isEmpty():
            return edges, small
    # Far from each other however pivots fall: every pair of blocks is a region of its own.
    weight = large.groupBy("region").agg(F.greatest(F.ceil(F.sum("n") * 2 / F.lit(cap)), F.lit(1)).alias("blocks"))
    cut = large.join(weight, "region").withColumn("i", F.pmod(F.xxhash64("id"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    small.append(cut.select(F.xxhash64("region", F.lit("b"), F.least("i", "j"), F.greatest("i", "j")).alias("region"), "id", "n", "elems", "core"))
    return edges, small


def ngram_jaccard_join(docs: DataFrame, n: int = N_WORDS, num: int = NUM, den: int = DEN, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents connected by Jaccard similarity >= num / den.

    component_id is the least doc_id reachable over links, the document itself included.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = c.materialise(own.mapInArrow(_scan(n), "kind int, doc_id long, n long, s1 long, s2 long, cls long, v binary"), "sets")
    counted = scanned.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counters = np.zeros(COUNTERS, dtype=np.int32)
    counters[counted.column("doc_id").to_numpy()] = np.minimum(counted.column("n").to_numpy(), 2**31 - 1)
    each = scanned.where("kind = 0").select("doc_id", "n", "s1", "s2", "cls", "v")
    classes = c.materialise(each.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("cls").alias("cls"), F.min("v").alias("v")), "classes")

    # 2: islands
    keys = c.materialise(own.select("text").mapInArrow(_prefixes(n, num, den, counters), "key long, cls long"), "keys")
    shared = keys.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("z"), F.count("*").alias("m")).where("a < z").select("key", "a", "m")
    rows = c.materialise(keys.join(shared, "key").select("key", "cls", "a", "m"), "shared")
    c.drop_scratch(keys)
    wide = rows.where((F.col("m") > WIDE) & (F.col("a") != F.col("cls"))).select("a", F.col("cls").alias("b"))
    regions = rows.where(F.col("m") <= WIDE).select("key", "cls").repartition("key").sortWithinPartitions("key").mapInArrow(_runs(_regions), "gid long, cls long").distinct()
    placed = regions.join(classes.select("cls", "n", "v"), "cls").select("gid", "cls", "n", "v")
    near = placed.repartition("gid").sortWithinPartitions("gid").mapInArrow(_runs(_neighbours(num, den)), "a long, b long").union(wide).distinct()
    islands = c.materialise(c.components(near), "islands")
    c.drop_scratch(rows)
    return join_islands(own, each, classes, islands, n, num, den, cap)


def join_islands(own: DataFrame, each: DataFrame, classes: DataFrame, islands: DataFrame, n: int, num: int, den: int, cap: int) -> DataFrame:
    """Steps 3 and 4: (doc_id, n_shingles, component_id) from islands (id, component) of classes, links decided on full sets.

    own: (doc_id, text). each: a row (doc_id, n, s1, s2) per document. classes: (n, s1, s2, cls, rep), rep the least doc_id.
    """
    # regions name classes by numbers of 63 bits: less than 0 means no core there
    classes = classes.withColumn("id", F.col("cls").bitwiseAND(F.lit(ID_BITS)))
    members = classes.select("rep", "n", "cls", "id").join(islands.withColumnRenamed("id", "cls"), "cls")
    members = c.materialise(members.select(F.col("rep").alias("doc_id"), "id", F.col("component").alias("region"), "n"), "members")
    picked = members.select("doc_id", "id", "region")
    few = members.count() <= BROADCAST_ROWS
    texts = own.join(F.broadcast(picked) if few else picked, "doc_id")
    sets = texts.select("id", "text", "region").mapInArrow(_sets(n), SETS)
    if _repeats(each):
        sets = sets.dropDuplicates(["id"])
    weight = members.groupBy("region").agg(F.sum("n").alias("w"), F.count("*").alias("m")).where(_too_large(cap)).select("region")
    edges: list[DataFrame] = []
    if weight.isEmpty():
        small = [sets]
    else:
        sets = c.materialise(sets, "elems")
        more, small = _split_large(sets.join(weight, "region", "left_semi"), num, den, cap)
        edges += more
        small.append(sets.join(weight, "region", "left_anti"))
    for s in small:
        edges.append(s.groupBy("region").applyInArrow(_join_group(num, den), "a long, b long"))
    links = edges[0]
    for e in edges[1:]:
        links = links.unionByName(e)
    linked = c.materialise(c.components(links).select("id", "component").join(classes.select("id", "rep"), "id"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))

    # back to documents
    named = classes.join(linked.join(least, "component").select("id", "least"), "id", "left").select("n", "s1", "s2", F.coalesce("least", "rep").alias("least"))
    return each.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _repeats(each: DataFrame) -> bool:
    return not each.groupBy("doc_id").count().where("count > 1").isEmpty()


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(c.table(spark, sf_dir, "documents"))
