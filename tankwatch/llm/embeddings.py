"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are rotated to their leading principal directions and sorted by the grid cells, of side epsilon, that
they fall in. Runs of this order are blocks with bounding boxes; two blocks, or two halves of them, whose boxes are
further apart than epsilon cannot hold a link and are skipped, down to intervals that are compared by exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import components, discard, written

#: Leading directions that are gridded, vectors in a block, and in an interval that is compared as it is.
DIRECTIONS, BLOCK, LEAF = 8, 1024, 256
#: Vectors from whose second moments the directions are taken (they only decide the order, not the result).
SAMPLE = 20_000


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector can have links, with the vector's 64-bit values and its length."""
    for batch in batches:
        rows = []
        for vec_id, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if vec_id is None or label is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append((vec_id, label, len(x), x.tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["node", "label", "size", "vector"])


def unit(rows: np.ndarray) -> np.ndarray:
    """Scaled before squaring, so that tiny and huge values neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _boxes(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lead.min(axis=0), lead.max(axis=0)


def _far(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    (al, ah), (bl, bh) = _boxes(a), _boxes(b)
    gap = np.maximum(0, np.maximum(al - bh, bl - ah))
    return float(gap @ gap) > epsilon * epsilon


class Links:
    """Counts of links by vector, and a forest of links: enough to connect what is connected."""

    def __init__(self, n: int):
        self.count = np.zeros(n, dtype=np.int64)
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))


def join_intervals(x: np.ndarray, raw: np.ndarray, lead: np.ndarray, copies: np.ndarray, a: tuple[int, int], b: tuple[int, int], least: float, epsilon: float, out: Links) -> None:
    """Recursive step: all links between two intervals of the order; ``a`` and ``b`` are the same or apart."""
    if a != b and _far(lead[a[0] : a[1]], lead[b[0] : b[1]], epsilon):
        return
    if a[1] - a[0] > LEAF or b[1] - b[0] > LEAF:
        halves = lambda i: [(i[0], (i[0] + i[1]) // 2), ((i[0] + i[1]) // 2, i[1])] if i[1] - i[0] > LEAF else [i]
        ha, hb = halves(a), halves(b)
        for k, one in enumerate(ha):
            for two in hb[k:] if a == b else hb:
                join_intervals(x, raw, lead, copies, one, two, least, epsilon, out)
        return
    dots = x[a[0] : a[1]] @ x[b[0] : b[1]].T
    linked = dots >= least
    for i, j in np.argwhere(np.abs(dots - least) < 1e-9):  # rounding could decide: sum exactly
        linked[i, j] = cosine(raw[a[0] + i], raw[b[0] + j]) >= least
    if a == b:
        np.fill_diagonal(linked, False)
    if linked.any():
        out.count[a[0] : a[1]] += linked @ copies[b[0] : b[1]]
        if a != b:
            out.count[b[0] : b[1]] += copies[a[0] : a[1]] @ linked
        rows, cols = np.nonzero(np.triu(linked) if a == b else linked)
        out.add(rows + a[0], cols + b[0])


#: How far a block's place in the order is shifted to name its interval: a partition of the order, 1,024 blocks, 32, one.
SHIFTS = (32, 10, 5, 0)


def _near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``(one, two)`` of blocks whose boxes come within epsilon: the recursive join of intervals of the order.

    Pairs of whole partitions that are too far apart are skipped with all that they hold; the others are taken apart,
    level by level, down to single blocks.
    """
    key = ["label", "size"]
    boxes = [F.min("low").alias("low"), F.max("high").alias("high")]
    each = blocks.select(*key, "place", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "z")).select(*key, "place", "axis", "z.low", "z.high")

    def level(shift: int, above: int) -> DataFrame:
        by_axis = each.groupBy(*key, F.shiftright("place", shift).alias("at"), "axis").agg(*boxes)
        own = by_axis.groupBy(*key, "at").agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("sides"))
        return written(own.select(*key, "at", F.shiftright("at", above - shift).alias("above"), F.transform("sides", lambda s: s["low"]).alias("low"), F.transform("sides", lambda s: s["high"]).alias("high")), "level")

    gap = F.aggregate(F.zip_with(F.zip_with("a.low", "b.high", lambda p, q: p - q), F.zip_with("b.low", "a.high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size"))
    ordered = (F.col("a.at") <= F.col("b.at")) & (gap <= epsilon * epsilon)
    top = level(SHIFTS[0], SHIFTS[0])
    # at the top, intervals meet in cells of the first direction
    met = top.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low")[0] / epsilon), F.floor(F.col("high")[0] / epsilon) + 1)))
    now = met.alias("a").join(met.alias("b"), same & (F.col("a.cell") == F.col("b.cell")) & ordered)
    pairs, spent = now.select("a.label", "a.size", F.col("a.at").alias("p"), F.col("b.at").alias("q")).distinct(), [top]
    for above, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        own = level(shift, above)
        spent.append(own)
        first = pairs.alias("s").join(own.alias("a"), (F.col("s.label") == F.col("a.label")) & (F.col("s.size") == F.col("a.size")) & (F.col("s.p") == F.col("a.above")))
        pairs = first.join(own.alias("b"), same & (F.col("s.q") == F.col("b.above")) & ordered).select("a.label", "a.size", F.col("a.at").alias("p"), F.col("b.at").alias("q"))
    names = blocks.select(*key, "place", "block")
    found = pairs.join(names.select(*key, F.col("place").alias("p"), F.col("block").alias("one")), [*key, "p"]).join(names.select(*key, F.col("place").alias("q"), F.col("block").alias("two")), [*key, "q"])
    out = written(found.select("one", "two"), "near")
    discard(*spent)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine ``least`` or more between vectors with equal labels, as classes.

    One row for each input row: ``vec_id, n_links, component_id, kept``. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id reachable by links (the own one included), ``kept`` tells whether that
    is the row itself. Cosines are taken in double precision; where rounding could decide, sums are exact. A vector that
    is null, empty, zero or has a null or non-finite value, and a null label or id, link with nothing; vectors of
    different lengths do not link; labels may be of any type. Equal vectors of a label are compared once and counted as often as they occur. Rows that share an
    id count as rows of their own, with one component. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    epsilon = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    kind = dict(vectors.dtypes)[label_col]
    label = F.col(label_col) + 0.0 if kind in ("double", "float") else F.col(label_col)  # one zero
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector_col).alias("v"))
    good = written(rows.mapInArrow(_valid, "node long, label string, size int, vector binary").withColumn("key", F.xxhash64("label", "vector")), "vectors")
    # exact copies: one of them, the one with the smallest id, stands for all
    single = written(good.groupBy("label", "size", "key", "vector").agg(F.min("node").alias("node"), F.count("*").alias("copies")), "single")
    sizes = [r["size"] for r in single.select("size").distinct().collect()]
    place = F.pmod(F.xxhash64("vector", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    rate = min(1.0, SAMPLE / max(single.count(), 1))
    axes = {}
    for size in sizes:
        got = single.where((F.col("size") == size) & (place < rate)).select("vector").toPandas()["vector"]
        x = unit(np.frombuffer(b"".join(got), dtype=np.float64).reshape(-1, size)) if len(got) else np.eye(size)
        values, directions = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(axis=0), x.mean(axis=0)))
        axes[size] = directions[:, ::-1][:, :DIRECTIONS]
    held = spark.sparkContext.broadcast(axes)

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.floor(unit(np.frombuffer(v.as_buffer(), dtype=np.float64)[None, :])[0] @ held.value[n] / epsilon).astype(np.int64).tolist() for v, n in zip(batch.column("vector"), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    kinds = "label string, size int, node long, copies long, vector binary"
    order = ["label", "size", "cells", "node"]
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-single.count() // BLOCK)))
    ordered = single.select("label", "size", "node", "copies", "vector").mapInArrow(gridded, f"{kinds}, cells array<long>").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most BLOCK vectors of one label, each as a row with its box."""
        wait: list[tuple] = []
        made: list[int] = []

        def row() -> tuple:
            raw = b"".join(w[4] for w in wait)
            lead = unit(np.frombuffer(raw, dtype=np.float64).reshape(len(wait), -1)) @ held.value[wait[0][1]]
            low, high = _boxes(lead)
            out = (wait[0][2], wait[0][0], wait[0][1], np.array([w[2] for w in wait], dtype=np.int64).tobytes(), np.array([w[3] for w in wait], dtype=np.int64).tobytes(), raw, low.tolist(), high.tolist(), (TaskContext.get().partitionId() << 32) + len(made))
            made.append(out[0])
            wait.clear()
            return out

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)), kinds, strict=True)], names=["block", "label", "size", "nodes", "copies", "raw", "low", "high", "place"])

        for batch in batches:
            done = []
            for one in zip(*(batch.column(c).to_pylist() for c in ("label", "size", "node", "copies", "vector")), strict=True):
                if wait and (wait[0][:2] != one[:2] or len(wait) == BLOCK):
                    done.append(row())
                wait.append(one)
            if done:
                yield table(done)
        if wait:
            yield table([row()])

    blocks = written(ordered.mapInArrow(blocked, "block long, label string, size int, nodes binary, copies binary, raw binary, low array<double>, high array<double>, place long"), "blocks")
    near = _near_blocks(blocks.select("block", "label", "size", "low", "high", "place"), epsilon)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["one"] == r["two"]
                sides = [(r["nodes"], r["copies"], r["raw"])] + ([] if same else [(r["nodes2"], r["copies2"], r["raw2"])])
                nodes, copies = (np.concatenate([np.frombuffer(s[k], dtype=np.int64) for s in sides]) for k in (0, 1))
                raw = np.concatenate([np.frombuffer(s[2], dtype=np.float64).reshape(-1, r["size"]) for s in sides])
                x, cut = unit(raw), len(sides[0][0]) // 8
                lead, out = x @ held.value[r["size"]], Links(len(nodes))
                first, second = (0, cut), (0, cut) if same else (cut, len(nodes))
                join_intervals(x, raw, lead, copies, first, second, least, epsilon, out)
                some = np.flatnonzero(out.count)
                ea, eb = (np.array([e[k] for e in out.edges], dtype=np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[nodes[some], nodes[ea]]), pa.array(np.r_[out.count[some], np.zeros(len(ea), np.int64)]), pa.array([None] * len(some) + nodes[eb].tolist(), pa.int64())], names=["node", "links", "other"])

    left = blocks.select(F.col("block").alias("one"), "size", "nodes", "copies", "raw")
    right = blocks.select(F.col("block").alias("two"), F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"), F.col("raw").alias("raw2"))
    found = written(near.join(left, "one").join(right, "two").mapInArrow(compare, "node long, links long, other long"), "found")
    discard(near, blocks)
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = written(single.join(counts, "node", "left").join(groups, "node", "left").select("label", "size", "key", "vector", F.col("node").alias("least"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "placed")
    # a row's own class comes by its vector; every copy of it counts as a link but itself
    own = good.join(placed.select("label", "key", F.col("vector").alias("w"), "copies", "links", "component"), ["label", "key"]).where("vector = w").groupBy("node").agg(F.max(F.col("links") + F.col("copies") - 1).alias("links"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(own, rows["vec_id"] == own["node"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
