"""Problem 4: the most similar vectors of every vector.

Unit vectors are mapped to a few dimensions by stable (Gaussian) projections: the squared projected distance of two vectors,
divided by their squared distance, is chi-square distributed with as many degrees of freedom as there are dimensions. Each
projection has a kd-tree whose upper splits are fitted on a bounded sample (SAMPLE rows), and whose lower ones in the tasks on samples of
each cell (SPLITS in all); every vector is put into a leaf of every tree. Within a leaf a vector meets its neighbours in the order of projected distance and verifies them, until the next one is so
far away that a closer vector would have been met with probability CONFIDENCE (chi-square test on the k-th best distance so far,
or on the largest distance asked for).

A row that has more neighbours within the asked distance than a leaf can rank (a dense cluster) is searched exactly as well: on
its float32 vector, against all classes (block_search), ties by id. So are copies of one direction in many lengths, whose unit
vectors differ in their last bits.

Equal unit vectors are one class and enter the trees once, so that no number of copies can fill a leaf; leaves of different
vectors hold equal shares of the sample and are split on in the task by local medians. What travels to the leaves are 8-bit codes;
pairs found are computed again from the vectors themselves.

For neighbours that are far away no tree of few dimensions can tell near from far. nearest() therefore takes a stated set of
queries in slices against all rows, tree leaf by tree leaf with the same test.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import marked
from millrace.session import scratch_path, written

TREES, DIMS, LEAF, SAMPLE, CONFIDENCE = 12, 16, 384, 20_000, 0.98

#: Splits of all trees that are broadcast, at most (5 bytes each); bits that number the cells of a tree.
SPLITS, TREE_BITS = 1 << 22, 40

#: Queries that one pass over all rows answers (as a broadcast of some 20 MB at a width of 64), and those compared at a time.
SLICE, BLOCK = 65_536, 4096


def chi_square(p: float, dims: int) -> float:
    """The p-quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    c = 2 / (9 * dims)
    return dims * (1 - c + NormalDist().inv_cdf(p) * sqrt(c)) ** 3


def projection(tree: int, width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(7919 + tree).standard_normal((width, dims)).astype(np.float32)


def usable(v: Column, width: int) -> Column:
    """Vectors of the width without null, NaN or infinite components and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == width) & ~bad & F.exists(v, lambda x: x != 0)


def units(docs: DataFrame, width: int, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, key, unit): the usable vectors as unit vectors (little-endian float32 bytes) and a 128-bit digest of each."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of extreme components stay finite
            u = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype("<f4") + np.float32(0)
            raw = [r.tobytes() for r in u]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "unit"])

    rows = docs.select(F.col(id).alias("id"), F.col(embedding).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), width))
    return rows.mapInArrow(scale, "id long, key binary, unit binary")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width)


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimensions and values of a complete kd-tree, nodes numbered from 1; each splits where the sample spreads most."""
    dim, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth, np.float32)
    node = np.ones(len(points), np.int64)
    for level in range(depth):
        for k in range(1 << level, 2 << level):
            own = points[node == k]
            if len(own):
                dim[k] = np.argmax(own.var(axis=0))
                value[k] = np.median(own[:, dim[k]])
        node = 2 * node + (points[np.arange(len(points)), dim[node]] > value[node])
    return dim, value


def leaf_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dim, value = tree
    node = np.ones(len(points), np.int64)
    for _ in range(len(dim).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), dim[node]] > value[node])
    return node


def lower_trees(placed: DataFrame, trees: int, depth: int, extra: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimensions and values [tree, cell, node] of a further kd-tree of `extra` levels inside each cell of trees of a depth,
    fitted in the tasks on the sampled rows placed (cell, rep, code); at most SPLITS of them reach the driver."""

    def fit(cell: pa.Table) -> pa.Table:
        number = int(cell["cell"][0].as_py())
        dim, value = fit_tree(_vectors(cell["code"], width) @ projection(number >> TREE_BITS, width, DIMS), extra)
        return pa.table({"cell": [number], "dim": [dim.astype("u1").tobytes()], "value": [value.astype("<f4").tobytes()]})

    rows = placed.groupBy("cell").applyInArrow(fit, "cell long, dim binary, value binary").toArrow()
    dim, value = np.zeros((trees, 1 << depth, 1 << extra), "u1"), np.zeros((trees, 1 << depth, 1 << extra), "<f4")
    for number, d, v in zip(*(rows[c].to_pylist() for c in ("cell", "dim", "value"))):
        t, node = number >> TREE_BITS, (number & ((1 << TREE_BITS) - 1)) - (1 << depth)
        dim[t, node], value[t, node] = np.frombuffer(d, "u1"), np.frombuffer(v, "<f4")
    return dim, value


def local_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree over these points; equal points are halved too."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = points[rows]
        order = rows[np.argsort(own[:, np.argmax(own.var(axis=0))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def leaf_neighbours(v: np.ndarray, p: np.ndarray, k: int, farthest: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (query, neighbour) within a leaf: up to k neighbours of each within squared distance `farthest`; and the rows
    that have more than k so near, which a leaf cannot rank.

    v: unit vectors; p: their projections; factor: the chi-square quantile of the stopping test.
    """
    # one product gives all squared distances: (-2p, |p|^2, 1) . (p', 1, |p'|^2)
    n, sq, one = len(p), (p * p).sum(axis=1, keepdims=True), np.ones((len(p), 1), np.float32)
    near = (np.concatenate((-2 * p, sq, one), axis=1) @ np.concatenate((p, one, sq), axis=1).T).ravel()
    near[:: n + 1] = np.inf
    found = np.flatnonzero(near <= farthest * factor)
    q, x = np.divmod(found, n)
    if not len(q):
        return q, x, q
    order = np.lexsort((near[found], q))
    q, x, gap = q[order], x[order], near[found][order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = np.full((len(v), k), np.inf, np.float32)
    got = np.full(len(q), np.inf, np.float32)
    step = 16
    for first in range(0, int(place.max()) + 1, step):
        now = (place >= first) & (place < first + step)
        # the stopping test, before each step: is the next projected distance still within reach of the k-th best?
        head = np.zeros(len(v), bool)
        at = now & (place == first)
        head[q[at]] = gap[at] <= np.minimum(best[q[at], k - 1], farthest) * factor
        now &= head[q]
        i = np.flatnonzero(now)
        if not len(i):
            break
        got[i] = 2 - 2 * np.einsum("ij,ij->i", v[q[i]], v[x[i]])
        add = np.full((len(v), step), np.inf, np.float32)
        add[q[i], place[i] - first] = got[i]
        best = np.sort(np.concatenate((best, add), axis=1), axis=1)[:, :k]
    keep = got <= np.minimum(best[q, k - 1], farthest) + 1e-6
    return q[keep], x[keep], np.flatnonzero(np.bincount(q[got <= farthest], minlength=n) > k)


def _codes(u: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.rint(u / np.abs(u).max(axis=1, keepdims=True) * 127).astype(np.int8)]


def _vectors(codes: pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors of codes."""
    v = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(-1, width).astype(np.float32)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def class_pairs(classes: DataFrame, width: int, k: int, min_cosine: float) -> DataFrame:
    """(a, b, cosine), a < b: pairs of classes (rep, unit) with at least min_cosine that the trees find among the k nearest of either."""
    count, spark = classes.count(), classes.sparkSession
    levels = max(0, ceil(log2(max(1, count) / LEAF)))
    depth = min(int(log2(SAMPLE / 8)), levels)
    # further levels are fitted in the tasks, on about 8 rows a leaf, as far as SPLITS allows
    extra = min(levels - depth, max(0, int(log2(SPLITS / TREES)) - depth))
    # the trees' upper splits are fitted on at most SAMPLE rows, drawn by a hash; few more than these leave the tasks
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, count // SAMPLE))) == 0)
    sample = drawn.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("unit").toArrow()
    fitted = [fit_tree(_matrix(sample["unit"], width) @ projection(t, width, DIMS), depth) for t in range(TREES)] if count else []

    def placed(rows: DataFrame, lower=None) -> DataFrame:
        """(cell, rep, code) of rows in every tree. lower: a broadcast of the splits below the cells of the upper trees."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = _matrix(batch.column(1), width)
                code, at = pa.array(_codes(u), pa.binary()), np.arange(len(u))
                for t, tree in enumerate(fitted):
                    points = u @ projection(t, width, DIMS)
                    cell = leaf_of(points, tree)
                    if lower is not None:
                        dim, value = (x[t] for x in lower.value)
                        upper, node = cell - (1 << depth), np.ones(len(u), np.int64)
                        for _ in range(extra):
                            node = 2 * node + (points[at, dim[upper, node]] > value[upper, node])
                        cell = (cell << extra) + node - (1 << extra)
                    yield pa.RecordBatch.from_arrays([pa.array(cell + (t << TREE_BITS)), batch.column(0), code], names=["cell", "rep", "code"])

        return rows.select("rep", "unit").mapInArrow(place, "cell long, rep long, code binary")

    lower = None
    if extra:
        some = classes.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(max(1, count // (8 << (depth + extra))))) == 0)
        lower = spark.sparkContext.broadcast(lower_trees(placed(some), TREES, depth, extra, width))

    slack = 0.03  # for the rounding of the codes
    farthest, factor = 2 - 2 * min_cosine + slack, chi_square(CONFIDENCE, DIMS)

    def meet(cell: pa.Table) -> pa.Table:
        ids = cell["rep"].to_numpy()
        v = _vectors(cell["code"], width)
        p = v @ projection(int(cell["cell"][0].as_py()) >> TREE_BITS, width, DIMS)
        a, b, dense = [], [], []
        for rows in local_leaves(p, 2 * LEAF):
            q, x, full = leaf_neighbours(v[rows], p[rows], k + 3, farthest, factor)
            a.append(ids[rows[q]]), b.append(ids[rows[x]]), dense.append(ids[rows[full]])
        a, b, dense = np.concatenate(a), np.concatenate(b), np.concatenate(dense)
        low, high = np.concatenate((np.minimum(a, b), dense)), np.concatenate((np.maximum(a, b), dense))
        return pa.table({"a": low, "b": pa.array(high, mask=np.arange(len(low)) >= len(a))})

    # as many partitions as the rows ask for, each of some 100,000: what a task reads does not grow with the table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(count * TREES / 100_000))
    pairs = written(placed(classes, lower).repartition(tasks, "cell").groupBy("cell").applyInArrow(meet, "a long, b long").distinct(), "pairs")
    vectors = classes.select(F.col("rep").alias("id"), "unit")
    dense = written(vectors.join(pairs.where("b is null").select(F.col("a").alias("id")), "id", "left_semi"), "dense")
    pairs = pairs.where("b is not null")
    if not dense.isEmpty():
        exact = block_search(vectors, dense, k, width).where(F.col("cosine") >= min_cosine)
        pairs = pairs.unionByName(exact.select(F.least("id", "neighbour_id").alias("a"), F.greatest("id", "neighbour_id").alias("b"))).distinct()
    return cosines(pairs, classes.select(F.col("rep").alias("id"), "unit"), width).where(F.col("cosine") >= min_cosine)


def cosines(pairs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) with the cosine of their unit vectors (id, unit)."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.einsum("ij,ij->i", _matrix(batch.column(2), width).astype(np.float64), _matrix(batch.column(3), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["a", "b", "cosine"])

    left, right = (vectors.select(F.col("id").alias(x), F.col("unit").alias(f"u_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "u_a", "u_b").mapInArrow(dot, "a long, b long, cosine double")


def similar_pairs(docs: DataFrame, k: int = 5, min_cosine: float = 0.9, width: int = 64, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with at least min_cosine of which one is among the k most similar rows of the other.

    Equal similarities (to 6 digits) rank by id. Vectors that are null, of another width, all zero, or hold null, NaN or infinite
    components take no part; an empty table gives an empty result; other columns are ignored.
    """
    rows = written(units(docs, width, id, embedding), "units")
    classes = written(rows.groupBy("key").agg(F.min(F.struct("id", "unit")).alias("r"), F.count("*").alias("n")).selectExpr("key", "r.id as rep", "r.unit as unit", "n"), "classes")
    near = written(class_pairs(classes, width, k, min_cosine), "near")
    sizes = classes.select("rep", "n")
    members = rows.select("id", "key").join(classes.where("n > 1").select("key", "rep"), "key").select("rep", "id")
    # the first k + 1 members of each class of several; Spark limits each task to so many before the shuffle
    first = members.selectExpr("rep", "id", "row_number() over (partition by rep order by id) as place").where(F.col("place") <= k + 1)
    inside = members.join(first.select("rep", F.col("id").alias("other"), "place"), "rep").where("id <> other").where((F.col("place") <= k) | (F.col("id") < F.col("other"))).select("id", "other")
    # other classes fill the places that a class's own members leave
    both = near.select("a", "b", "cosine").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    asked = both.join(sizes.where(F.col("n") <= k).select(F.col("rep").alias("a"), "n"), "a")
    single = sizes.where("n = 1").select("rep", F.col("rep").alias("id"))
    heads = single.unionByName(first.where(F.col("place") <= k).select("rep", "id"))
    offered = asked.join(heads.select(F.col("rep").alias("b"), F.col("id").alias("other")), "b")
    taken = offered.selectExpr("a", "n", "other", "row_number() over (partition by a order by round(cosine, 6) desc, other) as place").where(F.col("place") <= k + 1 - F.col("n"))
    across = taken.join(heads.withColumnRenamed("rep", "a"), "a").select("id", "other")
    return inside.unionByName(across).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def nearest(docs: DataFrame, queries: Column, k: int = 5, width: int = 64, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, neighbour_id, rank, cosine): the k most similar other rows of each row for which `queries`, a condition on id, holds.

    The queries go through all rows in slices of SLICE, each a broadcast of at most SLICE * width numbers and one pass. A task splits its
    rows by a kd-tree over the projections and goes through the leaves; a query skips a leaf when its box is farther than the stopping
    test of its k-th best similarity so far allows. Null and unusable vectors as in similar_pairs; ties (to 6 digits) rank by id. The search itself is in single precision and finds k + 3 rows; their similarities are computed again in double precision.
    """
    rows = written(units(docs, width, id, embedding).select("id", "unit"), "units")
    found = written(block_search(rows, rows.where(queries), k + 3, width).select("id", "neighbour_id"), "found")
    asked = found.select(F.explode(F.array("id", "neighbour_id")).alias("id"))
    vectors = marked(docs.where(usable(F.col(embedding), width)).select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v")), asked, "id")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten(), np.float64).reshape(-1, width) for i in (2, 3))
            c = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["id", "neighbour_id", "cosine"])

    both = found.join(vectors.withColumnRenamed("v", "v_a"), "id").join(vectors.select(F.col("id").alias("neighbour_id"), F.col("v").alias("v_b")), "neighbour_id")
    exact = both.select("id", "neighbour_id", "v_a", "v_b").mapInArrow(dot, "id long, neighbour_id long, cosine double").withColumn("cosine", F.round("cosine", 6))
    ranked = exact.selectExpr("id", "neighbour_id", "cast(row_number() over (partition by id order by cosine desc, neighbour_id) as int) as rank", "cosine")
    return ranked.where(F.col("rank") <= k)


def block_search(rows: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """(id, neighbour_id, rank, cosine): nearest() for unit vectors (id, unit), of all those asked."""
    spark = rows.sparkSession
    slices = max(1, ceil(asked.count() / (SLICE * 0.9)))
    numbered = asked.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(slices)))
    r, factor = projection(0, width, DIMS), chi_square(CONFIDENCE, DIMS)
    path, found = scratch_path(spark, "found"), None
    for s in range(slices):
        part = numbered.where(F.col("slice") == s).toArrow()  # at most some SLICE vectors
        ids, qv = part["id"].to_numpy(), _matrix(part["unit"], width)
        shared = spark.sparkContext.broadcast((ids, qv, qv @ r))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, qp = shared.value
            best, name = np.full((len(qid), k), -np.inf), np.full((len(qid), k), -1, np.int64)
            for batch in batches:
                bid, v = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
                p = v @ r
                for own in local_leaves(p, 1024):
                    low, high = p[own].min(axis=0), p[own].max(axis=0)
                    for at in range(0, len(qid), BLOCK):
                        now = slice(at, at + BLOCK)
                        box = (np.maximum(0, np.maximum(low - qp[now], qp[now] - high)) ** 2).sum(axis=1)
                        last = best[now, -1]
                        go = at + np.flatnonzero(box <= np.where(np.isfinite(last), 2 - 2 * last + 2e-6, np.inf) * factor + 1e-5)
                        if len(go):
                            best[go], name[go] = _better(best[go], name[go], qid[go], q[go], bid[own], v[own], k)
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, k)[ok.ravel()]), pa.array(name[ok]), pa.array(best[ok])], names=["id", "neighbour_id", "cosine"])

        found = rows.mapInArrow(search, "id long, neighbour_id long, cosine double")
        if slices > 1:
            found.write.mode("append").parquet(path)
    if slices > 1:
        found = spark.read.schema(found.schema).parquet(path)
    ranked = found.selectExpr("id", "neighbour_id", "cast(row_number() over (partition by id order by round(cosine, 6) desc, neighbour_id) as int) as rank", "round(cosine, 6) as cosine")
    return ranked.where(F.col("rank") <= k)


def _better(best: np.ndarray, name: np.ndarray, qid: np.ndarray, q: np.ndarray, bid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what queries have (cosines, names) and of a block of vectors, by the 6 digits that ties are told by, then by id."""
    c = q @ v.T
    c[qid[:, None] == bid[None, :]] = -np.inf
    c = np.round(c.astype(np.float64), 6)
    # of very many equal ones (copies of any length) the first are kept
    order = np.argsort(np.argsort(bid))
    top = np.argpartition(order / (len(order) * 1e6) - c, min(k, c.shape[1]) - 1, axis=1)[:, :k]
    c, n = np.concatenate((best, np.take_along_axis(c, top, 1)), axis=1), np.concatenate((name, bid[top]), axis=1)
    order = np.lexsort((n, -c), axis=1)[:, :k]
    return np.take_along_axis(c, order, 1), np.take_along_axis(n, order, 1)
