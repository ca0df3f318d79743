"""Near-duplicate embeddings by epsilon grid order join.

Unit vectors whose cosine is at least c lie within epsilon = sqrt(2 - 2c). Vectors are sorted by their grid cells (edge epsilon) on the
leading principal dimensions, and cut into blocks that are intervals of this order. Pairs of blocks whose cells are next to each other
meet; two intervals are halved until they are small or provably more than epsilon apart, and what is left is compared in double precision.

A pair of blocks gives, for each vector, its number of links, and enough links to connect what it found: a group of n copies costs no
n**2 rows. The principal dimensions come from at most SAMPLE vectors; they only decide how much can be skipped, not what is found.

Defined cases: vectors that are null, zero, or have null or non-finite components link with nothing and are kept; vectors of different
lengths don't link; equal vectors are one with a multiplicity; repeated and null identifiers are allowed (a component is named by its
smallest); an empty table gives an empty result; input columns come back inside `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import components
from quern.llm.vectors import lengths, matrix, usable
from quern.session import cut, parts_for, ship

BLOCK, LEAF, DIMENSIONS, SAMPLE = 4096, 512, 6, 20_000
#: Blocks meet on the cells of so many leading dimensions that none goes to more cells than this (one dimension at least).
CELLS = 1024
#: Distances are compared with this much to spare, so that rounding skips nothing.
SPARE = 1e-6
_BLOCKS = "block long, low array<double>, high array<double>, nodes binary, times binary, points binary, vectors binary"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(vectors: DataFrame) -> np.ndarray:
    """Leading principal dimensions (columns) of a bounded sample: the SAMPLE vectors with the smallest hashes."""
    rows = vectors.orderBy("node").limit(SAMPLE).select("vector").toArrow()
    u = _unit(matrix(rows.column("vector")))
    _, found = np.linalg.eigh(np.cov(u.T) if len(u) > 1 else np.eye(u.shape[1]))
    return found[:, ::-1][:, :DIMENSIONS]


def _project(axis: np.ndarray, epsilon: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_unit(matrix(batch.column("vector"))) @ axis / epsilon).astype(np.int32)
                at = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(cells.reshape(-1)))], ["node", "times", "vector", "cells"])

    return project


def _pack(axis: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to blocks; a block's number is its first vector's node."""
        left: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            v = matrix(rows.column("vector"))
            points = _unit(v) @ axis
            node, times = rows.column("node").to_numpy(), rows.column("times").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([points.min(0).tolist()]), pa.array([points.max(0).tolist()]), *(pa.array([x.tobytes()], pa.binary()) for x in (node, times, points, v))], ["block", "low", "high", "nodes", "times", "points", "vectors"])

        for batch in batches:
            left.append(batch)
            while sum(b.num_rows for b in left) >= BLOCK:
                rows = pa.Table.from_batches(left)
                yield block(rows.slice(0, BLOCK))
                left = rows.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in left):
            yield block(pa.Table.from_batches(left))

    return pack


def _leaves(p: np.ndarray, q: np.ndarray, epsilon: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of intervals, halved while they are long, that the leading dimensions can't keep apart."""
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:  # each pair of intervals once
            continue
        gap = np.maximum(0, np.maximum(p[a:b].min(0) - q[c:d].max(0), q[c:d].min(0) - p[a:b].max(0)))
        if gap @ gap > (epsilon + SPARE) ** 2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between numbers below n, the smallest number that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join(cosine: float, epsilon: float):
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pair of blocks a row. Out: (node, null, links) and (node, node, null) for a link."""
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[r]  # noqa: E731, B023
                same = get("block").as_py() == get("block2").as_py()
                sides = []
                for s in ("", "2"):
                    node = np.frombuffer(get("nodes" + s).as_buffer(), np.int64)
                    raw = get("vectors" + s).as_buffer()
                    v = np.frombuffer(raw, np.float32 if batch.column("width")[r].as_py() == 4 else np.float64).reshape(len(node), -1)
                    sides.append((node, np.frombuffer(get("times" + s).as_buffer(), np.int64), np.frombuffer(get("points" + s).as_buffer(), np.float64).reshape(len(node), -1), _unit(v)))
                (n1, t1, p1, u1), (n2, t2, p2, u2) = sides
                count1, count2 = np.zeros(len(n1), np.int64), np.zeros(len(n2), np.int64)
                ends: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b, c, d in _leaves(p1, p2, epsilon, same):
                    hit = u1[a:b] @ u2[c:d].T >= cosine
                    if same and a == c:
                        np.fill_diagonal(hit, False)
                    if not hit.any():
                        continue
                    count1[a:b] += hit @ t2[c:d]
                    if not (same and a == c):
                        count2[c:d] += t1[a:b] @ hit
                    i, j = np.nonzero(hit)
                    label = _forest(i, j + (b - a), b - a + d - c)
                    tree = np.flatnonzero(label != np.arange(len(label)))
                    both = np.concatenate([n1[a:b], n2[c:d]])
                    ends.append((both[tree], both[label[tree]]))
                if same:
                    count1, count2 = count1 + count2, count2[:0]
                node, n = np.concatenate([n1, n2[: len(count2)]]), np.concatenate([count1, count2])
                node, n = node[n > 0], n[n > 0]
                x, y = (np.concatenate(z) for z in zip(*ends)) if ends else (np.empty(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, x])), pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(y, pa.int64())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(x), pa.int64())])], schema=out_schema)

    return join


def joined(vectors: DataFrame, cosine: float) -> DataFrame:
    """vectors: node, times, vector (different vectors of one length). Returns rows (node, null, links) and (node, node, null), as _join says."""
    epsilon = float(np.sqrt(max(1e-6, 2 - 2 * cosine)))  # a wider one only skips less
    axis = axes(vectors)
    cells = vectors.select("node", "times", "vector").mapInArrow(_project(axis, epsilon), T.StructType([*vectors.select("node", "times", "vector").schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    order = [F.col("cells")[i].alias(f"c{i}") for i in range(axis.shape[1])]
    sorted_ = cells.repartitionByRange(parts_for(vectors, 64 << 20, least=4), *order, "node").sortWithinPartitions(*order, "node")
    blocks = cut(sorted_.select("node", "times", "vector").mapInArrow(_pack(axis), _BLOCKS))
    box = blocks.select("block", "low", "high")
    cell = lambda x: F.floor(x / epsilon).cast("long")
    left, right = box, box.select(F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = [f"cell{i}" for i in range(min(axis.shape[1], max(1, int(np.log(CELLS) / np.log(2 / epsilon + 2)))))]
    for i, c in enumerate(meet):  # a cell and the next one on each side: neighbours share one on every dimension
        left = left.withColumn(c, F.explode(F.sequence(cell(F.col("low")[i]), cell(F.col("high")[i]) + 1)))
        right = right.withColumn(c, F.explode(F.sequence(cell(F.col("low2")[i]), cell(F.col("high2")[i]) + 1)))
    gap = F.aggregate(F.arrays_zip("low", "high", "low2", "high2"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["low"] - x["high2"], x["low2"] - x["high"]), F.lit(2)))
    pairs = left.join(right, meet).where(F.col("block") <= F.col("block2")).where(gap <= (epsilon + SPARE) ** 2).select("block", "block2").distinct()
    wide = 4 if vectors.schema["vector"].dataType.elementType == T.FloatType() else 8
    other = blocks.select(*[F.col(c).alias(c + "2") for c in ("block", "nodes", "times", "points", "vectors")])
    both = pairs.join(blocks.drop("low", "high"), "block").join(other, "block2").withColumn("width", F.lit(wide))
    return both.mapInArrow(_join(cosine, epsilon), "a long, b long, n long")


def near(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.9, carry: list[str] | None = None) -> DataFrame:
    """For every row: row (a struct of its columns, or of carry), n_links (other rows linked directly), component_id (smallest key reachable)."""
    ship(rows.sparkSession)
    v = F.col(f"`{vector}`")
    named = rows.select(F.struct(*[F.col(f"`{c}`") for c in carry or rows.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.when(usable(v), F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("vector"))  # -0.0 becomes 0.0
    named = named.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    vectors = cut(named.where("node is not null").groupBy("vector").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("times"), F.min("key").alias("key")))
    found = None
    for n in lengths(vectors, "vector"):
        more = joined(vectors.where(F.size("vector") == n), cosine)
        found = more if found is None else found.union(more)
    if found is None:
        return named.select("row", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    found = cut(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(found.where("b is not null").select("a", "b"))
    nodes = cut(vectors.select("node", "times", "key").join(counts, "node", "left").join(label, "node", "left").select("node", "key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = nodes.groupBy("component").agg(F.min("key").alias("component_id"))
    told = nodes.select("node", "n_links", "component").join(least, "component").drop("component")
    return named.drop("vector").join(told, "node", "left").select("row", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
