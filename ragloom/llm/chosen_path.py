"""MinHash near-dedup by a chosen-path set similarity join.

1. Equal shingle sets are one class; only one document of a class goes on. A set has COORDINATES minwise tokens,
   each the least shingle under an order of its own: two sets of similarity s agree in a coordinate with
   probability s. A byte of each is the set's sketch.
2. TREES independent trees. At the root a document branches by its minwise token at each of BRANCHES chosen
   coordinates, at every node below by those that the node's name selects, so a node holds documents that agree in
   every coordinate of its path. Two sets at the threshold share a branch of a node with 1 - 0.15 ** 2
   = 0.98 and stay together in 1.7 branches on average, unlike ones (s < 0.5) in less than one, so theirs die out.
3. Nodes of up to SMALL documents are compared exhaustively, sketch by sketch. In larger ones each document is first
   compared with PIVOTS documents of the node: one that agrees with a pivot in CORE of the coordinates leaves the
   node with it, and whatever agrees in ATTACH is bound to that pivot too; the others branch on. Agreement is a metric
   on sketches: what agrees in NEAR coordinates with one that left agrees in CORE - (COORDINATES - NEAR) = ATTACH or
   more with its pivot, so no partner of the ones that left is lost. Nodes still large at DEPTH are bound whole.
4. What is bound together is a candidate group, no link yet. The links of each group are decided on the full
   shingle sets, exactly, by the join of ngram_jaccard's regions (large groups are split by pivots over the cluster).

Recall: a linked pair (s >= 0.85) shares no root branch of any tree with probability 0.15 ** 12 = 1e-10; with the
sub-trees below large nodes counted (a branching process that dies out with 0.03) it is lost with 0.176 ** 12 =
9e-10 at most. Sketches of a linked pair agree in less than NEAR of the coordinates with 1e-6 or less, and
one pair lost does not part documents that others hold together. Links confirmed are exact: two different
shingles agree as 64-bit hashes with probability 2**-64.

Null, empty and wordless texts have no shingles and link with nothing. Texts of fewer than n words are one
shingle, the whole sequence. Very long texts are read whole, in slices of their own. Repeated rows (same doc_id and
text) act as one document; different texts under one doc_id link each for itself. A text whose rows all have a null
doc_id has no name: it links with nothing, its component is null and the query keeps it; a copy of a named text
shares that one's component. Ties between pivots go to the lesser hash. An empty table gives an empty result.
Further columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import ngram_jaccard as nj

NUM, DEN = 85, 100
COORDINATES, TREES, BRANCHES, DEPTH, SEED = 128, 6, 2, 8, 29
#: Documents of a node that are compared exhaustively.
SMALL = 2048
PIVOTS = 8
#: Coordinates of COORDINATES in which sketches must agree: NEAR is 0.85 less five deviations.
NEAR, CORE = 89, 76
ATTACH = CORE - (COORDINATES - NEAR)
#: Pivots (about 200 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_ORDERS = c.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) | np.uint64(1)
#: The coordinates that the roots branch by, those of a tree next to each other.
_ROOTS = np.argsort(c.mix(np.arange(COORDINATES, dtype=np.uint64) ^ np.uint64(SEED << 8)))[: TREES * BRANCHES]


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, a row of COORDINATES each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), COORDINATES), dtype=np.uint64)
    for k, order in enumerate(_ORDERS):
        out[:, k] = np.minimum.reduceat(flat * order, at)
    return c.mix(out)


def _scan(n: int):
    """Per document its set size, its signature, its sketch and the names of its nodes below the roots."""

    def run(batches):
        import pyarrow as pa

        for batch in c.slices(batches, 1):
            sets = list(nj.shingle_sets(c.texts_of(batch.column(1)), n))
            marks, size = [nj.signature(s) for s in sets], [len(s) for s in sets]
            full = [i for i, s in enumerate(size) if s]
            sketches, nodes = [None] * len(sets), [None] * len(sets)
            for lo in range(0, len(full), 256):
                some = full[lo : lo + 256]
                tokens = minwise([sets[i] for i in some])
                names = c.signed(c.mix(tokens[:, _ROOTS] ^ c.mix(_ROOTS.astype(np.uint64) + np.uint64(1))))
                for i, sketch, own in zip(some, (tokens >> np.uint64(56)).astype(np.uint8), names, strict=True):
                    sketches[i], nodes[i] = sketch.tobytes(), own.tolist()
            cls = [nj.class_hash(k, *m) for k, m in zip(size, marks, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (size, [m[0] for m in marks], [m[1] for m in marks], cls)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "cls", "v", "nodes"])

    return run


def _fit(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as num / den."""
    return np.minimum(a, b) * den >= np.maximum(a, b) * num


def bind(n: np.ndarray, v: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect all pairs of near sketches, every two of them compared or connected already."""
    out, root = [], np.arange(len(n))
    for k in range(len(n) - 1):
        rest = np.flatnonzero((root[k + 1 :] != root[k]) & _fit(n[k + 1 :], n[k], num, den)) + k + 1
        for y in rest[(v[rest] == v[k]).sum(axis=1) >= NEAR] if len(rest) else ():
            if root[y] != root[k]:
                out.append((k, int(y)))
                root[root == root[y]] = root[k]
    return out


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _exhaust(num: int, den: int):
    """Edges of small nodes, from rows (node, cls, n, v) sorted by node; nodes of the same documents once a task."""

    def group(pa, t, state):
        done = state.setdefault("done", set())
        node, cls, n = (t.column(k).to_numpy() for k in ("node", "cls", "n"))
        v, at, got = _sketches(t.column("v")), nj._starts(node), set()
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = np.arange(lo, hi)[np.argsort(cls[lo:hi])]
            name = hash(cls[rows].tobytes())
            if name not in done:
                done.add(name)
                got.update((int(cls[rows[x]]), int(cls[rows[y]])) for x, y in bind(n[rows], v[rows], num, den))
        if len(done) > 1_000_000:
            done.clear()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    return nj._runs(group)


def _branch(level: int):
    """Members of large nodes beside their pivots: edges (a, b), each once a task, and rows (node, cls) of the next level."""

    def run(batches):
        import pyarrow as pa

        told: set[tuple[int, int]] = set()
        for batch in batches:
            node, cls = (batch.column(k).to_numpy() for k in ("node", "cls"))
            v, pivots = _sketches(batch.column("v")), batch.column("pivots").to_pylist()
            stays = np.ones(len(node), dtype=bool)
            edges, cache = [], {}
            for i, own in enumerate(pivots):
                if node[i] not in cache:
                    cache[node[i]] = (np.array([p["cls"] for p in own]), np.frombuffer(b"".join(p["v"] for p in own), dtype=np.uint8).reshape(-1, COORDINATES))
                names, sketches = cache[node[i]]
                same = (sketches == v[i]).sum(axis=1)
                bound = names[same >= ATTACH]
                if len(bound):  # to the least pivot, and the pivots to it
                    root = int(bound.min())
                    edges += [(x, root) for x in (int(cls[i]), *bound.tolist()) if x != root and (x, root) not in told]
                    told.update(edges[-len(bound) - 1 :])
                stays[i] = not (same >= CORE).any()
            if len(told) > 1_000_000:
                told.clear()
            left = np.flatnonzero(stays)
            nodes = []
            for b in range(BRANCHES):
                salt = c.mix(node[left].view(np.uint64) + np.uint64(level * BRANCHES + b + 1))
                pick = (salt % np.uint64(COORDINATES)).astype(np.int64)
                nodes.append(c.signed(c.mix(salt ^ (v[left, pick].astype(np.uint64) + np.uint64(1) << np.uint64(48)))))
            below, names = np.unique(np.stack([np.concatenate(nodes), np.tile(cls[left], BRANCHES)]), axis=1)
            pad, gap = [None] * len(edges), [None] * len(below)
            yield pa.RecordBatch.from_arrays([pa.array([*pad, *below.tolist()], pa.int64()), pa.array([*pad, *names.tolist()], pa.int64()), pa.array([a for a, _ in edges] + gap, pa.int64()), pa.array([b for _, b in edges] + gap, pa.int64())], names=["node", "cls", "a", "b"])

    return run


def candidate_edges(classes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Steps 2 and 3: edges (a, b) over classes (cls, n, v, nodes) that bind candidate groups."""
    sketches = classes.select("cls", "n", "v")
    rows = classes.select("cls", F.explode("nodes").alias("node"))
    small, edges = [], []
    for level in range(1, DEPTH + 1):
        sizes = c.materialise(rows.groupBy("node").agg(F.count("*").alias("m"), F.min("cls").alias("a")).where("m > 1"), "sizes")
        shared = rows.join(sizes, "node")
        small.append(shared.where(F.col("m") <= SMALL).select("node", "cls"))
        large = sizes.where(F.col("m") > SMALL).count()
        if not large:
            break
        wide = shared.where(F.col("m") > SMALL)
        if level == DEPTH:
            edges.append(wide.where("a <> cls").select("a", F.col("cls").alias("b")))
            break
        members = wide.select("node", "cls").join(sketches, "cls")
        slot = F.xxhash64("cls", F.lit(level))
        # at most PIVOTS a node, by minima within each task first
        chosen = members.groupBy("node", F.pmod(slot, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(slot.alias("h"), "cls", "v")).alias("x"))
        pivots = chosen.groupBy("node").agg(F.collect_list(F.struct("x.cls", "x.v")).alias("pivots"))
        if large * PIVOTS <= BROADCAST_ROWS:
            pivots = F.broadcast(pivots)
        made = members.join(pivots, "node").select("node", "cls", "v", "pivots").mapInArrow(_branch(level), "node long, cls long, a long, b long")
        made = c.materialise(made, "branches")
        edges.append(made.where("a is not null").select("a", "b"))
        rows = made.where("node is not null").select("cls", "node")
    nodes = small[0]
    for s in small[1:]:
        nodes = nodes.unionByName(s)
    out = nodes.join(sketches, "cls").select("node", "cls", "n", "v").repartition("node").sortWithinPartitions("node").mapInArrow(_exhaust(num, den), "a long, b long")
    for e in edges:
        out = out.unionByName(e)
    return out.distinct()


def near_duplicates(docs: DataFrame, n: int = nj.N_WORDS, num: int = NUM, den: int = DEN, cap: int = nj.CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable over links of similarity num / den or more."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    each = c.materialise(own.mapInArrow(_scan(n), "doc_id long, n long, s1 long, s2 long, cls long, v binary, nodes array<long>"), "sketches")
    classes = each.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("cls", "v", "nodes")).alias("x"))
    classes = c.materialise(classes.select("n", "s1", "s2", "rep", "x.*"), "classes")
    islands = c.materialise(c.components(candidate_edges(classes, num, den)), "islands")
    return nj.join_islands(own, each, classes, islands, n, num, den, cap)


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(c.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
