"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded joining, exact verification, components.

The weight of a shingle is its count. Weighted Jaccard similarity (sum of minima over sum of maxima) of two documents equals the plain
Jaccard similarity of their unit cells, the j-th occurrence of a shingle being a cell of its own. Darts fall on each cell as a hashed
Poisson process along an axis of ranks; each dart hits one of K coordinates, and the earliest dart of each coordinate is the signature.
Only darts below a rank that fills all coordinates are thrown, about K (ln K + 3) in all however long the text.

Documents that share a band are first compared with a leader of their bucket (LEADERS different ones over all bands), which brings tight
groups together at the cost of one comparison each. In buckets where more than one class is left, texts of different classes are compared
in blocks of packed cells, until their classes meet or all have been seen: no pair that shares a band loses its link, pairs are never rows,
and only texts that stay apart cost more than their group's size. A pair of similarity 0.8 shares a band with probability 0.9999.

Defined cases: null and empty texts have no shingles and are alone, each row a class of its own; a text of one to four words is one shingle;
copies of a text are always one class; repeated and null identifiers are allowed (a class is named by its smallest identifier); empty
tables give empty results; input columns come back inside `row`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.components import components
from quern.llm.packing import packed, unpacked
from quern.session import cut, drop, input_bytes, ship

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 24
#: Texts of a bucket that are compared as one block.
BLOCK = 512
#: Leaders differ between so many groups of bands, so that a large group's links don't all hang on one text.
LEADERS = 3
#: Bits of the map that spares work on texts without candidates; size of a table of pairs that is small enough to broadcast.
MARKS, FEW = 1 << 25, 256 << 10
U = np.uint64
_STEP, _WHERE, _WEIGHT = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((W.mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def unit_cells(words: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Cells of every text's shingle counts (hashes), and where each text's cells begin (one more for the end)."""
    h, first = W.rolling(words, at, size)
    text = np.searchsorted(at, first, "right") - 1
    n = np.diff(at)
    if len(brief := np.flatnonzero((n > 0) & (n < size))):
        h = np.concatenate([h, [W.mix(np.array([np.bitwise_xor.reduce(words[at[i] : at[i + 1]] * (np.arange(at[i + 1] - at[i], dtype=U) * U(2) + U(1)))], U))[0] for i in brief]])
        text = np.concatenate([text, brief])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))))
        nth = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
        h = np.where(nth > 0, W.mix(h + nth.astype(U) * _STEP), h)
    return h, np.searchsorted(text, np.arange(len(at)))


def darts(cells: np.ndarray, at: np.ndarray, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """Signatures (texts x k) of texts that have cells. part: for each cell, the share of it that belongs to the text (1 for whole cells)."""
    n = np.diff(at)
    best = np.full((len(n), k), np.iinfo(U).max, U)
    todo, most = np.flatnonzero(n > 0), k * (math.log(k) + 3)
    while len(todo):
        index = np.concatenate([np.arange(at[i], at[i + 1]) for i in todo]) if len(todo) < len(n) else np.arange(at[0], at[-1])
        text = np.repeat(todo, n[todo])
        limit = (most / n)[text] if len(todo) else np.empty(0)
        cell, share = cells[index], None if part is None else part[index]
        key, rank = cell + _STEP, np.zeros(len(cell))
        while len(key):
            rank = rank - np.log(_unit(key))
            keep = rank < limit
            key, rank, text, limit = key[keep], rank[keep], text[keep], limit[keep]
            dart = W.mix(key ^ _WHERE)
            hit = slice(None)
            if share is not None:
                share = share[keep]
                hit = _unit(key ^ _WEIGHT) < share
            earliest = (rank[hit].view(U) & ~U(0xFFFFFF)) | (dart[hit] & U(0xFFFFFF))
            np.minimum.at(best.reshape(-1), text[hit] * k + ((dart[hit] >> U(24)) % U(k)).astype(np.int64), earliest)
            key = key + _STEP
        todo, most = todo[(best[todo] == np.iinfo(U).max).any(1)], most * 4
        best[todo] = np.iinfo(U).max
    return best


def bands(signatures: np.ndarray) -> np.ndarray:
    """One hash for every ROWS coordinates."""
    out = np.empty((len(signatures), signatures.shape[1] // ROWS), U)
    for b in range(out.shape[1]):
        h = np.full(len(signatures), b + 1, U)
        for r in range(ROWS):
            h = W.mix(h * _STEP + signatures[:, b * ROWS + r])
        out[:, b] = h
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text", 2 << 20):
            cells, at = unit_cells(*W.hashes(piece.column("text")))
            some = np.flatnonzero(np.diff(at))
            found = bands(darts(cells, at, ROWS * BANDS)[some])
            yield pa.RecordBatch.from_arrays([piece.column("node").take(pa.array(some)), _lists(found.reshape(-1), np.arange(len(some) + 1) * BANDS)], ["node", "bands"])


def _cells(marks: np.ndarray):
    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of texts whose mark is set."""
        for batch in batches:
            at = batch.column("node").to_numpy().view(U) % U(MARKS)
            batch = batch.take(pa.array(np.flatnonzero(marks[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1))))
            for piece in W.pieces(batch, "text", 2 << 20):
                cells, at = unit_cells(*W.hashes(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("node"), _lists(cells, at)], ["node", "cells"])

    return cells_of


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bit map of MARKS bits, of fixed size, that has a bit for every node; it spares work on others and decides nothing."""
    bit = F.pmod(F.col("node"), F.lit(MARKS))  # MARKS is a power of 2, so this is the unsigned remainder too
    found = nodes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {MARKS}) & 63 AS int))")).alias("bits")).toPandas()
    out = np.zeros(MARKS // 64, U)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(U)
    return out


def _compared(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs: different (a, b), a below b. Returns them with their similarity; 0 where sizes alone keep it below what matters."""
    x = cells.select(F.col("node").alias("a"), F.col("cells").alias("x"))
    y = cells.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    if input_bytes(pairs) < FEW:  # few enough to go to the cells
        both = F.broadcast(pairs).join(x, "a").join(F.broadcast(pairs).join(y, "b"), ["a", "b"])
    else:
        both = pairs.join(x, "a").join(y, "b")
    n, m = F.size("x"), F.size("y")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", F.when(F.least(n, m) < SIMILARITY * F.greatest(n, m), 0.0).otherwise(common / (n + m - common)).alias("sim"))


_FOUND = "a long, b long, band long, block long, blocks long, data binary"


def _similar(cells: np.ndarray, at: np.ndarray, group: np.ndarray, begin: int = 0) -> list[tuple[int, int]]:
    """Links between texts of different groups, as many as bring their groups together: (i, j) with i >= begin, j < i, and j < begin if that is set.

    Every text from begin on is compared with all before it that it isn't connected to yet.
    """
    names, root = np.unique(group, return_inverse=True)
    if len(names) == 1:
        return []
    _, ids = np.unique(cells, return_inverse=True)
    mark, n, out = np.zeros(len(cells) + 1, bool), np.diff(at), []
    for i in range(max(begin, 1), len(n)):
        stop = begin or i
        apart = root[:stop] != root[i]
        if not apart.any():
            continue
        own = ids[at[i] : at[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[ids[: at[stop]]], at[:stop], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(apart & (common / (n[i] + n[:stop] - common) >= SIMILARITY)):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band and block to the links inside each block; a bucket of several blocks also gives its blocks, packed."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "band", "block", "blocks")] + [("data", pa.binary())])

    def block(rows: pa.Table) -> list[tuple]:
        first = lambda name: rows.column(name)[0].as_py()
        nodes, group = rows.column("node").to_numpy(), rows.column("class").to_numpy()
        lists = rows.column("cells").combine_chunks()
        cells, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        out = [(int(nodes[i]), int(nodes[j]), None, None, None, None) for i, j in _similar(cells, at, group)]
        if first("blocks") > 1:
            out.append((None, None, first("band"), first("block"), first("blocks"), packed(nodes.view(U), group.view(U), at, cells.view(U))))
        return out

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    left: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if left is None else pa.concat_tables([left, rows])
        if not rows.num_rows:
            continue
        band, blk = rows.column("band").to_numpy(), rows.column("block").to_numpy()
        ends = np.flatnonzero((band[1:] != band[:-1]) | (blk[1:] != blk[:-1])) + 1
        done = [x for a, b in zip(np.append(0, ends[:-1]), ends) for x in block(rows.slice(a, b - a))] if len(ends) else []
        left = rows.slice(ends[-1]) if len(ends) else rows
        if done:
            yield rows_of(done)
    if left is not None and left.num_rows and (done := block(left)):
        yield rows_of(done)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a bucket."""
    for batch in batches:
        for one, two in zip(batch.column("data").to_pylist(), batch.column("data2").to_pylist()):
            (n1, g1, a1, c1), (n2, g2, a2, c2) = unpacked(one), unpacked(two)
            nodes = np.concatenate([n1, n2]).view(np.int64)
            a1, a2 = a1.astype(np.int64), a2.astype(np.int64)
            found = _similar(np.concatenate([c1, c2]), np.concatenate([a1, a1[-1] + a2[1:]]), np.concatenate([g1, g2]), len(n1))
            yield pa.RecordBatch.from_arrays([pa.array([int(nodes[i]) for i, _ in found], pa.int64()), pa.array([int(nodes[j]) for _, j in found], pa.int64())], ["a", "b"])


def linked(rows: DataFrame) -> DataFrame:
    """rows: node (long, one for each different text), text. Returns node, component as components() does, for the links between texts."""
    signed = cut(rows.select("node", "text").mapInArrow(_sign, "node long, bands array<long>").dropDuplicates(["node"]))
    members = signed.select(F.posexplode("bands").alias("n", "band"), "node").select("band", "node", F.xxhash64("node", F.col("n") % LEADERS).alias("order"))
    ends = members.groupBy("band").agg(F.min(F.struct("order", "node")).alias("leader"), F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    members = cut(members.join(ends.select("band", F.col("leader.node").alias("leader")), "band"))
    wanted = cut(members.select("node").distinct())
    cells = rows.select("node", "text").mapInArrow(_cells(_marks(wanted)), "node long, cells array<long>")
    cells = cut(cells.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    led = cut(members.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    sims = _compared(led, cells)
    label = cut(components(sims.where(F.col("sim") >= SIMILARITY)))
    named = cut(members.select("band", "node").join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("class")))
    several = named.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    blocks = F.ceil(F.col("n") / BLOCK)
    open_ = named.join(several.select("band", blocks.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    dealt = open_.join(cells, "node").repartition("band", "block").sortWithinPartitions("band", "block")
    found = cut(dealt.select("band", "block", "blocks", "node", "class", "cells").mapInArrow(_within, _FOUND))
    one = found.where("a is null").select("band", "block", "blocks", "data")
    other = one.select("band", F.col("block").alias("block2"), F.col("data").alias("data2"))
    pairs = one.withColumn("block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).join(other, ["band", "block2"]).where("block2 < block")
    links = found.where("a is not null").select("a", "b").union(pairs.select("data", "data2").mapInArrow(_between, "a long, b long"))
    both = components(links.union(label.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    drop(signed, members, wanted, cells, led, label, named, found)  # components() has written what it returns
    return both


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """For every row of docs: row (a struct of its columns, or of carry), class_id (its class's smallest key), class_size (rows), node, class.

    node names the text, class the near-duplicate class (both are hashes, null for rows without words).
    """
    ship(docs.sparkSession)
    at = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), at.alias("text"), _node(at).alias("node"))
    label = linked(rows.where("node is not null")).select("node", F.col("component").alias("class"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes.join(label, "node", "left").select("node", "key", "n", F.coalesce("class", "node").alias("class")))
    sums = nodes.groupBy("class").agg(F.min("key").alias("class_id"), F.sum("n").alias("class_size"))
    named = nodes.select("node", "class").join(sums, "class")
    return rows.drop("text").join(named, "node", "left").select("row", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "node", "class")


def _node(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))
