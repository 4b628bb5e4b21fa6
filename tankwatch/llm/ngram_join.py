"""Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

All documents order their shingles alike, rare ones first. If two sets are similar enough, then their prefixes
(what may differ, and l more) share at least l shingles. Each document chooses its l by estimated cost: a longer
prefix has more postings but asks for more shared shingles before a pair is verified. Equal sets are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import discard, key_filter, may_hold, resolved, shared_buckets, written
from tankwatch.llm.wordhash import distinct, lots, mixed, rolling, word_hashes

#: Cells of the frequency sketch: a fixed size, whatever the input.
CELLS, CHUNK = 1 << 18, 1 << 12
AT_ONCE = 1 << 20
#: Columns of 64 parities each; they tell unlike sets apart up to some thousand shingles.
PARITIES = [f"p{k}" for k in range(8)]


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for the whole of a shorter text, none without words."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]  # bytes.lower changes A-Z only
    h, counts = word_hashes(raw)
    grams, out, at = rolling(h, size), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(distinct(grams[at : at + n - size + 1]))
        elif n:
            out.append(mixed(rolling(h[at : at + n], n)[:1] + np.uint64(n)))
        else:
            out.append(grams[:0])
        at += n
    return out


def parities_of(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` sets whether the number of its hashes is odd, by their top bits, as longs. ``owner`` is the set."""
    cells = 64 * len(PARITIES)
    at = owner * cells + (hashes >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(at, minlength=n * cells).reshape(n, cells) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets with these ``size`` and parities can have a Jaccard similarity of ``percent`` or more.

    A cell whose parities differ holds at least one element that only one set has, so that no link is lost.
    """
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    fits = F.least(f"{x}.size", f"{y}.size") * 100 >= F.greatest(f"{x}.size", f"{y}.size") * percent
    return fits & ((100 + percent) * apart <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size")))


def halves(hashes: np.ndarray) -> np.ndarray:
    """The upper half of each hash, which is all that the multi-match test moves about."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """A bound on how many hashes two sets share, from their halves: never less, and more only where halves meet by chance."""
    a, b = np.unique(x), np.unique(y)
    return len(np.intersect1d(a, b, assume_unique=True)) + min(len(x) - len(a), len(y) - len(b))


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class Order:
    """Frequency classes of the sketch's cells; the global order is (class, hash)."""

    def __init__(self, cells: np.ndarray, share: int):
        noise = np.median(cells)
        self.df = np.maximum(1.0, cells - noise - 3 * np.sqrt(max(noise, 1.0)))
        self.rank = np.floor(np.log2(self.df)).astype(np.uint8)
        self.share = share  # per cent

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The chosen prefix in order, how many of its shingles a partner must share (or the partner's own number),
        and the length of the plain prefix, of which similar sets share one shingle at least."""
        s = len(shingles)
        cell = (shingles & np.uint64(CELLS - 1)).astype(np.int64)
        order = np.argsort(self.rank[cell], kind="stable")  # shingles are sorted already
        may_differ = s - (-(-s * self.share // 100))
        base = 1 + s // 32
        cost, best = None, None
        posts = np.cumsum(self.df[cell[order[: may_differ + 4 * base]]])
        for asked in dict.fromkeys(min(s, base * k) for k in (1, 2, 4)):
            upto = min(s, may_differ + asked)
            others = posts[upto - 1] - upto
            now = posts[upto - 1] + s * others / asked
            if cost is None or now < cost:
                cost, best = now, (upto, asked - max(0, may_differ + asked - s))
        return shingles[order[: best[0]]], max(1, best[1]), may_differ + 1


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, n_shingles, component_id``, one row for each document.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| for their sets of distinct ``words``-word
    shingles (A-Z in lower case, words split at ASCII white space; a shorter text is one shingle). ``component_id`` is
    the smallest id reachable by links, the own one included. A text without words, or a null one, has no shingles
    and no links. Rows with a null id get a null component and link nothing; rows that share an id are copies of
    one document. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and at the end the task's share of the frequency sketch."""
        cells = np.zeros(CELLS, dtype=np.int64)
        none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
        names = ["doc_id", "node", "n_shingles", "chunk", "counts"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in lots([len(t) for t in texts], AT_ONCE):
                sets = shingle_sets(texts[begin:end], words)
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, n), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), none(n), none(n, pa.binary())], names=names)
        chunks = cells.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([none(len(chunks)), none(len(chunks)), none(len(chunks)), pa.array(range(len(chunks)), pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())], names=names)

    def added(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(c.as_buffer(), dtype=np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    surveyed = written(rows.mapInArrow(survey, "doc_id long, node long, n_shingles long, chunk long, counts binary"), "survey")
    heads = surveyed.where("chunk is null").select("doc_id", "node", "n_shingles")
    cells = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.float64)
    for r in surveyed.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(added, "chunk long, counts binary").collect():  # CELLS numbers
        cells[r.chunk] = np.frombuffer(r.counts, dtype=np.int64)
    cells = cells.ravel()
    order = spark.sparkContext.broadcast(Order(cells, percent))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct set of a lot: its prefix by halves, the plain prefix in full, and its parities."""
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in lots([len(t) for t in texts], AT_ONCE):
                sets = {node_of(s): s for s in shingle_sets(texts[begin:end], words) if len(s)}
                parts = [order.value.prefix(s) for s in sets.values()]
                sizes = np.fromiter(map(len, sets.values()), dtype=np.int64, count=len(sets))
                parities = parities_of(np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.zeros(0, np.uint64), *sets.values()]), len(sets))
                cols = [pa.array(list(sets), pa.int64()), pa.array([halves(p[0]).tobytes() for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.int32()), pa.array(sizes, pa.int32()), pa.array([p[0][: p[2]].tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(parities[:, k]) for k in range(len(PARITIES)))], names=["node", "prefix", "asked", "size", "keys", *PARITIES])

    kinds = "node long, prefix binary, asked int, size int, keys binary, " + ", ".join(f"{b} long" for b in PARITIES)
    prefixes = written(rows.where("doc_id is not null").mapInArrow(prefixed, kinds), "prefixes")
    shared = written(shared_buckets(prefixes.select("node", "keys")), "shared")
    own = prefixes.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    several = written(own.select("node", "prefix", "asked", "size", *PARITIES), "several")
    first = written(heads.join(several.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "first")
    discard(prefixes)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The whole sets of some nodes, by one scan that skips other documents and shuffles no text."""
        wanted = written(first.join(nodes, "node", "left_semi"), "wanted")
        held = spark.sparkContext.broadcast(key_filter(wanted, "doc_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.filter(pa.array(may_hold(held.value, batch.column("h").to_numpy())))
                texts = some.column("text").to_pylist()
                for begin, end in lots([len(t) for t in texts], AT_ONCE):
                    sets = shingle_sets(texts[begin:end], words)
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

        found = rows.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "node long, shingles binary")
        out = written(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
        discard(wanted)
        return out

    def prefixes_of(nodes: DataFrame) -> DataFrame:
        """The prefixes of some nodes, and few others: what has no part in a pair is not shuffled."""
        held = spark.sparkContext.broadcast(key_filter(nodes, "node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(held.value, batch.column("h").to_numpy()))).select(["node", "prefix", "asked"])

        return several.select("node", "prefix", "asked", F.xxhash64("node").alias("h")).mapInArrow(run, "node long, prefix binary, asked int")

    def share_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The multi-match test: as many shingles in both prefixes as the pair's shorter demand asks for."""
        for batch in batches:
            keep = []
            for x, y, asked in zip(batch.column("pa"), batch.column("pb"), np.minimum(batch.column("la").to_numpy(), batch.column("lb").to_numpy()).tolist(), strict=True):
                keep.append(most_shared(*(np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))) >= asked)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        met = written(pairs, "pairs")
        some = prefixes_of(met.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        left, right = (some.select(F.col("node").alias(n), F.col("prefix").alias(f"p{n}"), F.col("asked").alias(f"l{n}")) for n in ("a", "b"))
        enough = written(met.join(left, "a").join(right, "b").mapInArrow(share_enough, "a long, b long"), "enough")
        sets = sets_of(enough.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        out = written(enough.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "similar")
        discard(met, enough, sets)
        return out

    members = shared.join(several.select("node", "size", *PARITIES), "node")
    groups = resolved(members, verify, lambda x, y: may_link(x, y, percent))
    discard(shared, several, first)
    by_node = heads.groupBy("node").agg(F.min("doc_id").alias("least")).where("least is not null")
    joined = by_node.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(joined.join(lowest, "component").select("node", "component_id"), "classes")
    discard(groups)
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return heads.join(named, "node", "left").select("doc_id", "n_shingles", own.cast("long").alias("component_id"))
