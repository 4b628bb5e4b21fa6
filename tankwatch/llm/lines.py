"""Fuzzy line deduplication: MinHash signatures, banding, exact verification, one line kept for each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import bits_of, discard, key_filter, may_hold, may_link, resolved, rows_at_once, shared_buckets, written
from tankwatch.llm.wordhash import distinct, lots

SHINGLE, PERCENT = 7, 80
#: Two lines of similarity 0.8 share a band with probability 0.995, of 0.9 with more than 0.9999.
BANDS, ROWS = 10, 4
#: Bytes of the table of removed lines that are broadcast (a larger one is joined by shuffling); characters of lines
#: handled at once, and of which signatures are taken at once.
BROADCAST_BYTES, AT_ONCE, PIECE = 32 << 20, 2 << 20, 1 << 15
BITS = ["b0", "b1", "b2", "b3"]
#: A MinHash value is the least of ``hash * factor ^ turn``. The rows of a band have factors of their own; a factor serves
#: several bands, with turns that differ in their highest bits.
_FACTORS = np.random.default_rng(7).integers(1 << 20, 1 << 31, size=2 * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURNS = (np.arange(BANDS * ROWS, dtype=np.uint32) // np.uint32(len(_FACTORS)) << np.uint32(29)) ^ np.random.default_rng(8).integers(0, 1 << 29, size=BANDS * ROWS, dtype=np.uint32)


def canonical(line: str) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join(line.lower().split())


def node_of(line: str) -> int:
    n = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


_MIX = {np.uint64: (0x9E3779B97F4A7C15, 31, 0xC2B2AE3D27D4EB4F, 29, 0x165667B19E3779F9, 32, 0xD6E8FEB86659FD93, 29), np.uint32: (0x9E3779B1, 15, 0x85EBCA77, 13, 0xC2B2AE3D, 16, 0x27D4EB2F, 15)}


def shingle_hashes(texts: list[str], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``SHINGLE`` characters, and for each text where its first one is and how many it has.

    A shorter text is one run. Hashes between two texts' own belong to neither.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if len(sizes) and sizes.min() < SHINGLE:
        texts, sizes = [t.ljust(SHINGLE, "\0") for t in texts], np.maximum(sizes, SHINGLE)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(kind, copy=False)
    one, p, two, q, three, r, four, s = map(kind, _MIX[kind])
    h = codes[:-1] * one
    h += codes[1:]  # of two characters
    h ^= h >> p
    h, after = h[:-2] * two, h[2:]
    h += after  # of four
    h ^= h >> q
    h, after = h[:-3] * three, h[3:]
    h += after  # of seven: the fourth counts twice
    h ^= h >> r
    h *= four
    h ^= h >> s
    return h, np.cumsum(sizes) - sizes, sizes - SHINGLE + 1


def own_hashes(h: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' own hashes one after the other, and the number of each one's text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return h[np.arange(len(owner)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)], owner


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys (lines x bands)."""
    keys = np.zeros((BANDS, len(lines)), dtype=np.uint64)
    for begin, end in lots([len(t) for t in lines], PIECE):
        h, begins, counts = shingle_hashes(lines[begin:end], np.uint32)
        h = np.append(h, np.uint32(0))
        cuts = np.stack([begins, begins + counts], axis=1).ravel()  # own hashes and those between, in turn
        low, turned = np.empty((BANDS * ROWS, end - begin), dtype=np.uint32), np.empty_like(h)
        for k, factor in enumerate(_FACTORS):
            base = h * factor
            for row in range(k, BANDS * ROWS, len(_FACTORS)):
                np.bitwise_xor(base, _TURNS[row], out=turned)
                low[row] = np.minimum.reduceat(turned, cuts)[::2]
        key = np.full((BANDS, end - begin), np.uint64(0x51ED270B), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
        for row in range(ROWS):
            key = (key ^ low[row::ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(31)
        keys[:, begin:end] = key
    return np.ascontiguousarray(keys.T).view(np.int64)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each line stands, and its text and band keys; these once for a line that a lot has twice."""
    for batch in batches:
        texts, ids, rows_of = batch.column("text").to_pylist(), batch.column("doc").to_pylist(), batch.column("row").to_pylist()
        for begin, end in lots([len(t) for t in texts], AT_ONCE):
            spots, lines = [], {}
            for doc, row, text in zip(ids[begin:end], rows_of[begin:end], texts[begin:end], strict=True):
                for place, raw in enumerate(text.split("\n")):
                    if c := canonical(raw):
                        node = node_of(c)
                        spots.append((doc, row, place, node, None if node in lines else len(lines)))
                        lines.setdefault(node, c)
            if not spots:
                continue
            doc, row, place, node, first = zip(*spots, strict=True)
            pick = pa.array(first, pa.int64())
            full = [pa.array(lines.values(), pa.string()), pa.array([k.tobytes() for k in signatures(list(lines.values()))], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(node, pa.int64()), *(c.take(pick) for c in full)], names=["doc", "row", "place", "node", "line", "keys"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line the number of its different shingles, and 256 bits of these."""
    for batch in batches:
        lines = batch.column("line").to_pylist()
        for begin, end in lots([len(t) for t in lines], PIECE):
            own, owner = own_hashes(*shingle_hashes(lines[begin:end]))
            each = distinct((owner.astype(np.uint64) << np.uint64(44)) | (own >> np.uint64(20)))
            sizes = np.bincount((each >> np.uint64(44)).astype(np.int64), minlength=end - begin)
            bits = bits_of(owner, own, end - begin)
            yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))], names=["node", "line", "size", *BITS])


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    one, two = ({t[i : i + size] for i in range(max(1, len(t) - size + 1))} for t in (a, b))
    return len(one & two) / len(one | two)


class _Sets:
    """Shingles of a lot's lines: a bit map each to tell most unlike pairs, and the sets themselves where that leaves it open."""

    def __init__(self, lines: list[str]):
        self.own, self.maps, self.sets = {}, {}, {}
        for begin, end in lots([len(t) for t in lines], PIECE):
            h, begins, counts = shingle_hashes(lines[begin:end])
            for line, at, n in zip(lines[begin:end], begins.tolist(), counts.tolist(), strict=True):
                self.own[line] = h[at : at + n]

    def map(self, line: str) -> np.ndarray:
        """About eight bits for a shingle, a power of two; its halves laid on each other are the map of half the size."""
        if line not in self.maps:
            h = self.own[line]
            flags = np.zeros(1 << max(8, (8 * len(h) - 1).bit_length()), dtype=np.uint8)
            flags[(h & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
            self.maps[line] = np.packbits(flags).view(np.uint64)
        return self.maps[line]

    def set(self, line: str) -> np.ndarray:
        if line not in self.sets:
            self.sets[line] = distinct(self.own[line])
        return self.sets[line]

    def linked(self, x: str, y: str, sx: int, sy: int, percent: int) -> bool:
        a, b = self.map(x), self.map(y)
        while len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] | b[len(b) // 2 :]
        common = a & b
        shared = int(np.bitwise_count(common).sum())
        # a bit that only one has stands for a shingle at least that the other lacks
        most = min(sx - int(np.bitwise_count(a).sum()) + shared, sy - int(np.bitwise_count(b).sum()) + shared)
        if (100 + percent) * most < percent * (sx + sy):
            return False
        one, two = self.set(x), self.set(y)
        both = np.sort(np.concatenate([one, two]), kind="stable")  # merges two sorted runs
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * shared >= percent * (len(one) + len(two) - shared)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, sx, sy = (batch.column(c).to_pylist() for c in ("x", "y", "sx", "sy"))
            for begin, end in lots([len(a) + len(b) for a, b in zip(x, y, strict=True)], AT_ONCE):
                sets = _Sets(list(dict.fromkeys([*x[begin:end], *y[begin:end]])))
                keep = [sets.linked(*r, percent) for r in zip(x[begin:end], y[begin:end], sx[begin:end], sy[begin:end], strict=True)]
                yield batch.select(["a", "b"]).slice(begin, end - begin).filter(pa.array(keep, pa.bool_()))

    return run


#: Lines of a bucket that are compared with each other, or with as many others, at once; most bits of their maps.
BLOCK, MOST_BITS = 64, 1 << 13
#: Blocks that a task remembers, and rows of one or two blocks that reach it at once.
KNOWN, ROWS_AT_ONCE = 8, 64


def _crossed(percent: int):
    """Links between lines of two blocks (or of one), as many as join what they can join.

    The products of bit maps bound what two lines share; only pairs that the bound leaves open, and whose components no
    link found before has joined, are compared by their shingles.
    """

    def maps(sets: list[np.ndarray], bits: int) -> np.ndarray:
        out = np.zeros((len(sets), bits), dtype=np.float32)
        out[np.repeat(np.arange(len(sets)), [len(h) for h in sets]), (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = 1
        return out

    def sets_of(lines: list[str]) -> list[np.ndarray]:
        out = []
        for begin, end in lots([len(t) for t in lines], PIECE):
            h, begins, counts = shingle_hashes(lines[begin:end])
            out += [distinct(h[at : at + n]) for at, n in zip(begins.tolist(), counts.tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}  # blocks met just before: each meets all others of its bucket

        def block(key: tuple, lines: list[str]) -> tuple:
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                sets = sets_of(lines)
                sizes = np.array([len(h) for h in sets])
                bits = 1 << min(MOST_BITS.bit_length() - 1, max(8, int(8 * sizes.max()).bit_length()))
                known[key] = sets, sizes, maps(sets, bits)
            return known[key]

        def folded(a: np.ndarray, bits: int) -> np.ndarray:
            while a.shape[1] > bits:
                a = np.maximum(a[:, : a.shape[1] // 2], a[:, a.shape[1] // 2 :])
            return a

        for batch in batches:
            links: list[tuple[int, int]] = []
            for bucket, p, one, q, two in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "x", "other", "y")), strict=True):
                same = two is None
                x, sx, a = block((bucket, p), [m["line"] for m in one])
                y, sy, b = (x, sx, a) if same else block((bucket, q), [m["line"] for m in two])
                two = one if same else two
                bits = min(a.shape[1], b.shape[1])
                a, b = folded(a, bits), folded(b, bits)
                common = a @ b.T
                most = np.minimum((sx - a.sum(axis=1))[:, None], (sy - b.sum(axis=1))[None, :]) + common
                open_ = (100 + percent) * most >= percent * (sx[:, None] + sy[None, :]) - 0.5
                up: dict[int, int] = {}

                def root(c: int, up=up) -> int:
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for i, j in np.argwhere(np.triu(open_, 1) if same else open_).tolist():
                    r, t = root(one[i]["component"]), root(two[j]["component"])
                    if r == t:
                        continue
                    both = np.sort(np.concatenate([x[i], y[j]]), kind="stable")  # merges two sorted runs
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * shared >= percent * (len(both) - shared):
                        up[max(r, t)] = min(r, t)
                        links.append((one[i]["node"], two[j]["node"]))
            cols = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _cross(texts: DataFrame, percent: int):
    """All pairs of a bucket's lines that are not in one component yet, block by block."""

    def run(open_: DataFrame) -> DataFrame:
        sizes = open_.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = open_.select("bucket", "node", "component").join(sizes, "bucket").join(texts.select("node", "line"), "node")
        blocks = dealt.groupBy("bucket", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")).agg(F.collect_list(F.struct("node", "component", "line")).alias("lines"))
        one = written(blocks.withColumnRenamed("lines", "x"), "blocks")
        none = [F.lit(None).cast("long").alias("other"), F.lit(None).cast(one.schema["x"].dataType).alias("y")]
        within = one.where(F.size("x") > 1).select("bucket", "block", "x", *none)
        several = one.where("blocks > 1").select("bucket", "block", "x")
        between = several.join(several.select("bucket", F.col("block").alias("other"), F.col("x").alias("y")), "bucket").where("block < other").select("bucket", "block", "x", "other", "y")
        with rows_at_once(open_.sparkSession, ROWS_AT_ONCE):
            few = 4 * open_.sparkSession.sparkContext.defaultParallelism  # a task for a few small blocks would not be worth its start
            out = written(within.union(between).coalesce(few).mapInArrow(_crossed(percent), "a long, b long"), "crossed")
        discard(one)
        return out

    return run


def line_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with those lines left out that are like an earlier line.

    Lines end at line feeds. Two lines are linked if their sets of 7-character shingles, in lower case and with plain
    spaces, have a Jaccard similarity of ``percent`` per cent or more; equal lines always are. Of each connected
    component the first line by (id, place in the document) stays. Returns all columns of ``docs``, with the new text,
    and ``n_lines`` and ``n_removed`` (replacing columns of those names). Blank lines stay. A null text stays null with
    no lines; an empty text has one, blank. Rows with a null id are returned as they are and count for nothing. Equal
    rows are copies of one document, and keep or lose a line together; rows that share an id but not the text are
    documents of their own, in the order of a hash of their texts. Any other columns may be there.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text_hash = F.xxhash64(F.col(text_col))  # with the id, it names a row and its copies
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_hash.alias("row"), F.col(text_col).alias("text"))
    spots = written(rows.mapInArrow(_spots, "doc long, row long, place int, node long, line string, keys binary"), "spots")
    shared = written(shared_buckets(spots.where("keys is not null").select("node", "keys")), "bands")
    nodes, lines = shared.select("node").distinct(), spots.where("line is not null").select("node", "line")
    if shared.count() * 16 <= BROADCAST_BYTES:
        some = lines.join(F.broadcast(nodes), "node", "left_semi")
    else:  # the filter keeps most lines from being shuffled
        held = docs.sparkSession.sparkContext.broadcast(key_filter(nodes, "node", hashed=True))  # a node is a hash already

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(held.value, batch.column("node").to_numpy())))

        some = lines.mapInArrow(listed, "node long, line string").join(nodes, "node", "left_semi")
    texts = written(some.dropDuplicates(["node"]).mapInArrow(_sized, "node long, line string, size int, " + ", ".join(f"{b} long" for b in BITS)), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("node").alias(n), F.col("line").alias(t), F.col("size").alias(f"s{t}")) for n, t in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "sx", "sy").mapInArrow(_verified(percent), "a long, b long")

    members = shared.join(texts.drop("line"), "node")
    groups = resolved(members, verify, lambda x, y: may_link(x, y, percent), _cross(texts, percent))
    discard(shared, texts)
    # only lines that stand twice or have links can go
    placed, spot = spots.select("doc", "row", "place", "node"), F.struct("doc", "row", "place")
    twice = placed.groupBy("node").agg(F.count("*").alias("n")).join(groups, "node", "left").where("n > 1 or component is not null").select("node", F.coalesce("component", "node").alias("component"))
    several = written(placed.join(twice, "node").select(spot.alias("spot"), "component"), "several")
    kept = several.groupBy("component").agg(F.min("spot").alias("keep"))
    gone = several.join(kept, "component").where("spot <> keep").select("spot.*")
    removed = written(gone.groupBy("doc", "row").agg(F.collect_set("place").alias("places")), "removed")
    discard(spots, groups, several)
    size = removed.agg(F.sum(F.size("places") * 4 + 32)).first()[0] or 0
    own = removed.select(F.struct(F.col("doc"), F.col("row")).alias("_key"), "places")
    all_ = docs.select(F.struct(*rest).alias("_own"), F.struct(F.col(id_col).cast("long").alias("doc"), text_hash.alias("row")).alias("_key"))
    out = all_.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "_key", "left")
    text = F.col("_own").getField(text_col)
    each = F.split(text, "\n", -1)
    left = F.when(F.col("places").isNull(), text).otherwise(F.array_join(F.filter(each, lambda _, k: ~F.array_contains(F.col("places"), k)), "\n"))
    own_cols = [left.alias(c) if c == text_col else F.col("_own").getField(c).alias(c) for c in rest]
    return out.select(*own_cols, F.when(text.isNull(), 0).otherwise(F.size(each)).alias("n_lines"), F.when(text.isNull() | F.col("places").isNull(), 0).otherwise(F.size("places")).alias("n_removed"))
