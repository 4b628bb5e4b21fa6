"""Helpers that several of the operators share: written tables, splits, word rules, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, however small its file is: it is never broadcast through the driver."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may lack it; it then gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tankwatch-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tankwatch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_tankwatch_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def rows_at_once(spark: SparkSession, n: int):
    """Jobs that run inside send Python at most ``n`` rows at once: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, so the result does not depend on a locale or on Unicode tables."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Most bits of the filters below: a fixed bound, whatever the input.
FILTER = 1 << 27


def key_filter(keys: DataFrame, key: str, hashed: bool = False):
    """A Bloom filter over a long column: it lets all keys through, and few others.

    It has 16 bits for each row of ``keys``, but not more than ``FILTER``; beyond that it lets more others through.
    """
    size = 1 << min(FILTER.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
    h = F.col(key) if hashed else F.xxhash64(key)
    bit = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftright(h, 30).bitwiseAND(F.lit(size - 1))))
    words = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(size // 64, dtype=np.int64)
    got = words.toArrow()  # FILTER / 64 rows at most
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out.view(np.uint8)


def may_hold(bits, hashes):
    """Which keys, given by their xxhash64, the filter lets through."""
    last = 8 * len(bits) - 1
    get = lambda k: (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
    return get(hashes & last) & get((hashes >> 30) & last)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, component)`` for every node of an edge, where component is the smallest node
    reachable. Each round is a written table; a round's minima are pre-aggregated before the shuffle
    and attached by a join, which adaptive execution splits where a node has very many neighbours.
    """
    flat = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct()
    now = written(flat, "edges")
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every edge now points from a larger node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small, "edges")
        discard(now)
        now = new
        # in a star forest each node has one edge at most, and no centre has one
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or (low > 0 and high > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._tankwatch_path = now._tankwatch_path  # for discard()
    return out


#: Entries (a key of a node) that a task sorts at once, and about as many as meet in one group.
ENTRIES, BLOCK = 1 << 20, 1 << 19
#: Nodes of one key that a sorted run sends on to be met by those of other runs; further ones are known to be shared.
AT_KEY = 16


def shared_buckets(packed: DataFrame) -> DataFrame:
    """Buckets of nodes that share a key: ``bucket, node``, each row once.

    Keys with the same few nodes (fewer than ``AT_KEY``) are one bucket, named by a hash of the nodes; of others, the key
    is the bucket. ``packed(node, keys)`` holds 64-bit keys of a node as bytes. Tasks sort their entries in runs and send each group
    of keys one row of bytes for each run; a run sends ``AT_KEY`` nodes of a key only, and what it has more of a key
    is passed on as shared to a group by node, so that no group grows with the number of nodes of one key.
    """
    total = packed.agg(F.sum(F.length("keys"))).first()[0] or 0
    blocks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BLOCK)))

    def block_of(h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the key

    def meeting(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of entries sorted by key those whose key has two or more nodes, each once, and their places within the key."""
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        key, node = key[some], node[some]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
        key, node = key[fresh], node[fresh]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begin, len(key)])
        keep = np.repeat(sizes > 1, sizes)
        return key[keep], node[keep], (np.arange(len(key)) - np.repeat(begin, sizes))[keep]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def cut(direct: bool, key: np.ndarray, node: np.ndarray, block: np.ndarray) -> list[tuple]:
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
            return [(int(block[low]), direct, key[low:high].tobytes(), node[low:high].tobytes()) for low, high in zip(edges[:-1], edges[1:], strict=True)]

        def flush():
            key, node = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key.view(np.uint64))
            key, node = key[order], node[order]
            over = np.zeros((2, 0), np.int64)
            if len(key) > AT_KEY and (key[AT_KEY:] == key[:-AT_KEY]).any():
                k, n, place = meeting(key, node)
                over = np.stack([k, n])[:, place >= AT_KEY]
                # where a key has so many nodes, its entries are those sent on, once
                full = np.isin(key, over[0])
                few = np.isin(k, over[0]) & (place < AT_KEY)
                key, node = np.r_[key[~full], k[few]], np.r_[node[~full], n[few]]
                order = np.argsort(key.view(np.uint64), kind="stable")
                key, node = key[order], node[order]
                over = over[:, np.argsort(block_of(over[1]))]
            rows = cut(False, key, node, block_of(key)) + cut(True, over[0], over[1], block_of(over[1]))
            kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["block", "direct", "key", "node"])

        for batch in batches:
            keys = batch.column("keys")
            sizes = np.fromiter((len(k.as_buffer()) // 8 for k in keys), dtype=np.int64, count=len(keys))
            held.append((np.frombuffer(b"".join(keys.to_pylist()), dtype=np.int64), np.repeat(batch.column("node").to_numpy(), sizes)))
            if sum(len(h[0]) for h in held) > ENTRIES:
                yield flush()
        if held:
            yield flush()

    def met(_: tuple, group: pa.Table) -> pa.Table:
        def entries(direct: bool) -> list[np.ndarray]:
            some = group.filter(pc.equal(group.column("direct"), direct))
            return [np.frombuffer(b"".join(some.column(n).to_pylist()), dtype=np.int64) for n in ("key", "node")]

        key, node = entries(False)
        order = np.argsort(key.view(np.uint64), kind="stable")  # merges sorted runs
        key, node, _ = meeting(key[order], node[order])
        if len(key):
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begin, len(key)])
            n = node.view(np.uint64)
            n = (n ^ (n >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            name = np.bitwise_xor.reduceat(n ^ (n >> np.uint64(29)), begin) + sizes.astype(np.uint64)
            # a key that any run had more of has at least AT_KEY nodes here
            key = np.where(np.repeat(sizes < AT_KEY, sizes), np.repeat(name.view(np.int64), sizes), key)
        return pa.table({n: pa.array(np.concatenate([a, b])) for n, a, b in zip(("bucket", "node"), (key, node), entries(True), strict=True)})

    found = packed.mapInArrow(run, "block long, direct boolean, key binary, node binary").groupBy("block").applyInArrow(met, "bucket long, node long")
    return found.dropDuplicates(["bucket", "node"])


def bits_of(owner, hashes, n: int):
    """256 bits for each of ``n`` sets, as four longs: the bit that the top of each hash names. ``owner`` is the set."""
    flags = np.zeros((n, 256), dtype=np.uint8)
    flags[owner, (hashes >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(flags, axis=1, bitorder="little").view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets with these ``size`` and bits ``b0`` to ``b3`` can have a Jaccard similarity of ``percent`` or more.

    A bit that only one set has stands for at least one element that the other lacks, so that no link is lost.
    """
    lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.b{k}")))) for k in range(4)), F.lit(0))
    total = percent * (F.col(f"{x}.size") + F.col(f"{y}.size"))
    enough = lambda p, q: (100 + percent) * (F.col(f"{p}.size") - lacks(p, q)) >= total
    fits = F.least(f"{x}.size", f"{y}.size") * 100 >= F.greatest(f"{x}.size", f"{y}.size") * percent
    return fits & enough(x, y) & enough(y, x)


def resolved(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], cross: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components ``node, component`` of the linked nodes of candidate buckets.

    ``members(bucket, node, ...)`` holds buckets of two nodes or more; two nodes may only be linked if they share a
    bucket and ``near`` holds for the columns of both, which are given by prefix. ``verify`` keeps the linked ones of the
    pairs ``(a, b)``. First all nodes of a bucket meet its leader, the node with the most buckets, which the copies
    of one text have in common; this step has a pair for each member at most. Then all pairs of a bucket that are near and not yet
    in one component are tested, so that no link between components is left out: by ``cross``, which is given the
    buckets that are still open, with each node's component, and returns links ``(a, b)``, or as pairs.
    """
    own = [c for c in members.columns if c != "bucket"]
    # the node with the most buckets has the highest rank, and there is one such node
    rank = F.shiftleft(F.least(F.count("*"), F.lit(1023)), 53) + F.xxhash64("node").bitwiseAND(F.lit((1 << 53) - 1))
    ranks = members.groupBy("node").agg(rank.alias("rank"))
    placed, groups = written(members.join(ranks, "node").withColumn("component", F.col("node")), "placed"), None
    for step in ("leader", "all"):
        if step == "leader":
            leaders = placed.groupBy("bucket").agg(F.max("rank").alias("rank"))
        else:
            now = placed if groups is None else placed.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("bucket")  # two have met
            still = written(now.join(open_, "bucket", "left_semi"), "still")
            discard(placed)
            placed = still
            if placed.isEmpty():
                break
        if step == "all" and cross is not None:
            found = cross(placed)
        else:
            x, y = (placed.select("bucket", "rank", F.struct(*own, "component").alias(n)) for n in ("x", "y"))
            apart = F.col("x.component") < F.col("y.component") if step == "all" else F.col("x.component") != F.col("y.component")
            right = y if step == "all" else y.join(leaders, ["bucket", "rank"], "left_semi")
            pairs = x.drop("rank").join(right.drop("rank"), "bucket").where(apart & near("x", "y"))
            found = verify(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
        links = written(found, "links")
        if not links.isEmpty():
            stars = components(links if groups is None else links.union(groups.select("component", "node")))
            new = written(stars, "groups")
            discard(stars, *([] if groups is None else [groups]))
            groups = new
        discard(links)
    discard(placed)
    return groups if groups is not None else members.select("node", F.col("node").alias("component")).where("false")
