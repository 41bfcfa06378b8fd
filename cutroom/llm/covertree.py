"""Product-quantisation codes by Lloyd's rounds over partition-local cover trees.

Vectors are cut into parts; each part position has a codebook of its own. Every block of a partition gets one cover tree
for each part position: a node covers points within a radius that shrinks by ``SCALE`` from level to level, and keeps their
number and their sums by component. The trees are built once and written to the shared folder. In a round, a node's points all go to
one entry at once if the triangle inequality says so: an entry is nearer to the node's centre than any other by more than
twice the node's radius. Only nodes where that is open are descended, and only the points of open leaves are compared one by one.
What a block hands on is one row of sums for each used entry.

All results are whole numbers and exact: distances of floating point only decide, with a margin, whether a node is open.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, small_batches

PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
SCALE, LEAF = 1.3, 48
#: Components of 2**40 and more count as not finite, so that all sums have exact types.
LARGEST = float(1 << 40)
#: Whole numbers up to this have exact squared distances in 64 bits; beyond, Python's own are used.
IN_64_BITS = 1 << 26
#: Labels that are broadcast at most; with more, they are joined.
BROADCAST_LABELS = 1 << 16
#: Bytes of a batch of vectors, which is a block, at most: as Spark has it.
VECTOR_BYTES = 1 << 26


def build_tree(points: np.ndarray, scale: float = SCALE, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A cover tree of points (rows of numbers) whose leaves hold up to ``leaf`` points or equal ones.

    ``order`` lists the points so that a node has those from ``lo`` to ``hi``; children of a node are the nodes from ``first``
    to ``last``, none for a leaf. ``centre`` is a point's number. All nodes of a level are split at once: points beyond the next
    radius become centres of their own, one in each node at a time, and take the points around them that are left.
    """
    n = len(points)
    real = points.astype(np.float64)
    away = lambda at, centre: np.sqrt(((real[at] - real[centre]) ** 2).sum(axis=1))
    order = np.arange(n)
    dist = away(order, np.zeros(n, np.int64))
    level = {"lo": np.zeros(1, np.int64), "hi": np.full(1, n), "centre": np.zeros(1, np.int64), "radius": np.array([dist.max(initial=0.0)])}
    made, base = [], 0
    while len(level["lo"]):
        size = level["hi"] - level["lo"]
        split = np.flatnonzero((size > leaf) & (level["radius"] > 0))
        level["first"] = level["last"] = np.zeros(len(size), np.int64)
        made.append(level)
        if not len(split):
            break
        # the points of the nodes that are split, their node, and the child that takes them
        at = np.concatenate([np.arange(a, b) for a, b in zip(level["lo"][split], level["hi"][split], strict=True)])
        node = np.repeat(np.arange(len(split)), size[split])
        reach = level["radius"][split] / scale
        point, child = order[at], np.zeros(len(at), np.int64)
        own, centres = dist[at].copy(), [(np.arange(len(split)), level["centre"][split])]
        left, number = np.flatnonzero(own > reach[node]), 1
        while len(left):
            new = np.append(True, node[left][1:] != node[left][:-1])
            picked = np.zeros(len(split), np.int64)
            picked[node[left[new]]] = point[left[new]]
            centres.append((node[left[new]], point[left[new]]))
            far = away(point[left], picked[node[left]])
            near = far <= reach[node[left]]
            child[left[near]], own[left[near]] = number, far[near]
            left, number = left[~near], number + 1
        parent, centre = (np.concatenate([c[i] for c in centres]) for i in (0, 1))
        which = np.concatenate([np.full(len(c[0]), i) for i, c in enumerate(centres)])
        rank = np.lexsort((which, parent))
        parent, centre, which = parent[rank], centre[rank], which[rank]
        sort = np.lexsort((child, node))
        order[at], dist[at] = point[sort], own[sort]
        key, keys = (x[0] * number + x[1] for x in ((node[sort], child[sort]), (parent, which)))
        begin, end = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        base += len(size)
        level["first"], level["last"] = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        level["first"][split] = base + np.searchsorted(parent, np.arange(len(split)), "left")
        level["last"][split] = base + np.searchsorted(parent, np.arange(len(split)), "right")
        level = {"lo": at[begin], "hi": at[end - 1] + 1, "centre": centre, "radius": np.maximum.reduceat(own[sort], begin)}
    tree = {k: np.concatenate([x[k] for x in made]) for k in ("lo", "hi", "centre", "radius", "first", "last")}
    return tree | {"order": order}


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to all entries."""
    most = max((int(np.abs(x).max(initial=0)) for x in (points, entries)), default=0)
    kind = np.int64 if most <= IN_64_BITS else object
    out = np.zeros((len(points), len(entries)), kind)
    for j in range(points.shape[1]):
        out += (points[:, j, None].astype(kind) - entries[None, :, j].astype(kind)) ** 2
    return out


def assign(points: np.ndarray, tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each node, -1 where it is open or an ancestor has one, and of each place of ``order`` in open leaves, else -1."""
    nodes, places = np.full(len(tree["lo"]), -1), np.full(len(points), -1)
    real = entries.astype(np.float64)
    front = np.zeros(min(1, len(points)), np.int64)
    while len(front):
        centre = points[tree["centre"][front]].astype(np.float64)
        d = np.sqrt(((centre[:, None, :] - real[None]) ** 2).sum(axis=2))
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(front)), best]
        d[np.arange(len(front)), best] = np.inf
        sure = d.min(axis=1) - nearest > 2 * tree["radius"][front] + 1e-9 * (1 + nearest)
        nodes[front[sure]] = best[sure]
        front = front[~sure]
        alike = tree["radius"][front] == 0
        nodes[front[alike]] = squared(points[tree["centre"][front[alike]]], entries).argmin(axis=1)
        front = front[~alike]
        leaf = tree["first"][front] == tree["last"][front]
        if leaf.any():
            at = np.concatenate([np.arange(tree["lo"][i], tree["hi"][i]) for i in front[leaf].tolist()])
            places[at] = squared(points[tree["order"][at]], entries).argmin(axis=1)  # the first of equal ones
        inner = front[~leaf]
        front = np.concatenate([np.arange(tree["first"][i], tree["last"][i]) for i in inner.tolist()]) if len(inner) else inner
    return nodes, places


def node_sums(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Sums by component of each node's points."""
    running = np.zeros((len(points) + 1, points.shape[1]), np.int64 if len(points) * int(np.abs(points).max(initial=0)) < 1 << 62 else object)
    np.cumsum(points[tree["order"]].astype(running.dtype), axis=0, out=running[1:])
    return running[tree["hi"]] - running[tree["lo"]]


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components as whole numbers; all rows are of one length."""
    keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(keep)).flatten().cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(keep), -1)
    good = (np.abs(x) < LARGEST).all(axis=1) if x.size else np.zeros(len(keep), bool)
    return keep[good], np.floor(x[good] * STEPS).astype(np.int64)


def _cuts(width: int, parts: int) -> list[int]:
    return [j * width // parts for j in range(parts + 1)]


def _unpack(batch: pa.RecordBatch):
    """(vec ids, labels, points, trees) of the blocks of a batch."""
    for i in range(batch.num_rows):
        width = batch.column("width")[i].as_py()
        points = np.frombuffer(batch.column("points")[i].as_py(), np.int64).reshape(-1, width)
        yield batch.column("ids")[i].values, batch.column("labels")[i].values, points, pickle.loads(batch.column("trees")[i].as_py())


def next_codebooks(codebooks: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Entries become the floored means of what they were given, (part, entry, count, sums) each; unused ones stay."""
    out = [x.astype(object) for x in codebooks]
    for part, entry, count, total in sums:
        out[part][entry] = [int(x) // int(count) for x in total]
    return [x.astype(np.int64) for x in out]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept row.

    Rows go whose vector is null or holds a null, a component that isn't finite or one of 2**40 and more, or whose length
    isn't that of the first kept row by key (null keys last); an empty vector goes too. A length that ``parts`` doesn't divide is cut at
    floor(j * length / parts). The codebooks start as the parts of the kept rows with the smallest keys; rows that repeat
    a key come in the order of their vectors. With fewer rows there are fewer entries. Repeated rows stay rows of their own.
    An error beyond 64 bits is null. Other columns are not read. An empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("an entry's index has two hex digits")
    spark = vectors.sparkSession
    rows = small_batches(vectors, VECTOR_BYTES).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LARGEST) & ~F.isnan(x)))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(1).select(F.size("vector")).first()
    names = [key, "code", "error", "label_error", "codebooks_sha256"]
    if first is None:
        none = F.lit(None)
        return rows.limit(0).select(F.col("id").alias(key), *(none.cast(t).alias(c) for c, t in zip(names[1:], ("string", "long", "long", "string"), strict=True)))
    width = first[0]
    rows = rows.where(F.size("vector") == width)
    cuts = _cuts(width, parts)
    start = np.array([[int(np.floor(x * STEPS)) for x in r[0]] for r in rows.orderBy(*order).limit(entries).select("vector").collect()], np.int64)
    codebooks = [start[:, cuts[j] : cuts[j + 1]] for j in range(parts)]

    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    block = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("width", T.LongType()), T.StructField("points", T.BinaryType()), T.StructField("trees", T.BinaryType())])

    def planted(batches):
        """A block of a batch with its trees, one for each part position."""
        for batch in batches:
            keep, points = _whole(batch.column("vector"))
            if len(keep):
                at = pa.array(keep)
                trees = [build_tree(points[:, cuts[j] : cuts[j + 1]]) for j in range(parts)]
                trees = [{k: v.astype(np.float64 if k == "radius" else np.int32) for k, v in t.items()} for t in trees]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), batch.column(c).take(at)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([width]), pa.array([points.tobytes()], pa.binary()), pa.array([pickle.dumps(trees)], pa.binary())], names=block.names)

    grown = settle(rows.mapInArrow(planted, block))

    def round_sums(shared):
        def run(batches):
            total: dict[tuple[int, int], list] = {}  # parts x entries at most
            for batch in batches:
                for _, _, points, trees in _unpack(batch):
                    for j, (tree, book) in enumerate(zip(trees, shared.value, strict=True)):
                        own = points[:, cuts[j] : cuts[j + 1]]
                        nodes, places = assign(own, tree, book)
                        sums, size = node_sums(own, tree), tree["hi"] - tree["lo"]
                        ordered = own[tree["order"]]
                        for e in np.union1d(nodes[nodes >= 0], places[places >= 0]).tolist():
                            held = total.setdefault((j, e), [0, [0] * own.shape[1]])
                            held[0] += int(size[nodes == e].sum()) + int((places == e).sum())
                            for more in (sums[nodes == e], ordered[places == e]):
                                held[1] = [a + int(b) for a, b in zip(held[1], more.sum(axis=0), strict=True)]
            if total:
                cells = [(j, e, n, [str(x) for x in s]) for (j, e), (n, s) in total.items()]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["part", "entry", "n", "total"])

        return run

    for _ in range(rounds):
        sums = grown.mapInArrow(round_sums(spark.sparkContext.broadcast(codebooks)), "part int, entry int, n long, total array<string>")
        sums = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        totals: dict[tuple[int, int], dict] = {}
        for r in sums.collect():  # parts x entries x width of a part at most
            totals.setdefault((r["part"], r["entry"]), {"n": r["n"]})[r["at"]] = r["x"]
        codebooks = next_codebooks(codebooks, [(j, e, t["n"], [t[i] for i in range(cuts[j + 1] - cuts[j])]) for (j, e), t in totals.items()])

    shared = spark.sparkContext.broadcast(codebooks)
    coded = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def encoded(batches):
        for batch in batches:
            for ids, labels, points, trees in _unpack(batch):
                codes, errors = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), object)
                for j, (tree, book) in enumerate(zip(trees, shared.value, strict=True)):
                    own = points[:, cuts[j] : cuts[j + 1]]
                    nodes, places = assign(own, tree, book)
                    for i in np.flatnonzero(nodes >= 0).tolist():
                        places[tree["lo"][i] : tree["hi"][i]] = nodes[i]
                    codes[tree["order"], j] = places
                    gap = own - book[codes[:, j]]
                    exact = int(np.abs(gap).max(initial=0)) <= 2 * IN_64_BITS
                    errors += (gap.astype(np.int64 if exact else object) ** 2).sum(axis=1)
                digits = codes.tobytes().hex()
                text = [digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(points))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array([x if x < 1 << 63 else None for x in map(int, errors)], pa.int64())], names=coded.names)

    done = settle(grown.mapInArrow(encoded, coded))
    digest = hashlib.sha256(",".join(str(int(x)) for book in codebooks for x in book.ravel()).encode()).hexdigest()
    by_label = done.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = by_label.withColumn("label_error", F.col("label_error").try_cast("long"))
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = done.join(F.broadcast(by_label) if few else by_label, F.expr("label <=> same"), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
