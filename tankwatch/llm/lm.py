"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale, and a pair of level q is stored as the q keys
(pair, 1) ... (pair, q). Probing level after level until one is missing gives back the quantised count, which can be
too large by a false positive but never too small. The filter is made of blocks, each built where its pairs'
counts meet, and is broadcast to the workers that score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import written
from tankwatch.llm.wordhash import lots, mixed, word_hashes

#: Base of the count levels, hash functions for each level, and the least count of a pair that is stored.
BASE, HASHES, CUTOFF = 1.5, 6, 1
#: Up to this many bytes are broadcast at once: a larger filter is probed in several passes of that size,
#: and a larger word table is joined.
BROADCAST_BYTES = 96 << 20
AT_ONCE, POSTINGS, BLOCK = 1 << 20, 2_000_000, 1 << 18
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: What a level counts for; the last one lies above all 64-bit counts.
LEVELS = np.array([0, *(BASE ** (q + 0.5 - 1) for q in range(1, 110))])
LEVELS[1] = 1.0


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # bytes.lower changes A-Z only


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and tokens by text."""
    h, counts = word_hashes(texts)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def pairs(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token together with the one before it, or with the start."""
    before = np.r_[START, h[:-1]] if len(h) else h
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + h)


def spot(h: np.ndarray, blocks: int, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """A key's block, and the 40 bits that tell it apart there; words and pairs never meet."""
    return (h % np.uint64(blocks)).astype(np.int64), ((h // np.uint64(blocks)) & np.uint64((1 << 39) - 1)) | np.uint64(int(word) << 39)


def level(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9)).astype(np.int64) * (counts > 0)


@dataclass
class LogFilter:
    """Blocks of bits; a key's hash names its block, and its bits all lie there."""

    starts: np.ndarray
    bits: np.ndarray
    words: np.ndarray = field(repr=False)

    @staticmethod
    def turns(h: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        a = mixed(h + np.uint64((q * 0xA24BAED4963EE407) & (2**64 - 1)))
        return a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def places(h: np.ndarray, q: int, bits: np.ndarray) -> np.ndarray:
        a, b = LogFilter.turns(h, q)
        return (a[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * b[None, :]) % np.maximum(bits, 1).astype(np.uint64)[None, :]

    def levels(self, h: np.ndarray, word: bool) -> np.ndarray:
        """The highest level up to which all keys are present; 0 for blocks that this part of the filter lacks."""
        block, h = spot(h, len(self.bits), word)
        out = np.zeros(len(h), dtype=np.int64)
        open_ = np.flatnonzero(self.bits[block] > 0)
        q = 1
        while len(open_):
            a, b = self.turns(h[open_], q)
            own = block[open_]
            first, size = self.starts[own], self.bits[own].astype(np.uint64)
            for k in range(HASHES):  # most keys that are missing go at the first bits
                bit = first + ((a + np.uint64(k) * b) % size).astype(np.int64)
                held = (self.words[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if not held.all():
                    open_, a, b, first, size = open_[held], a[held], b[held], first[held], size[held]
            out[open_] = q
            q += 1
            if q >= len(LEVELS):
                break
        return out


def _bits(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """The bits of one block, sized for the keys that it holds."""
    q = level(counts)
    size = int(math.ceil(HASHES / math.log(2) * int(q.sum()) / 64)) * 64
    bits = np.zeros(size, dtype=np.uint8)
    for k in range(1, int(q.max(initial=0)) + 1):
        h = keys[q >= k]
        bits[LogFilter.places(h, k, np.full(len(h), size)).ravel().astype(np.int64)] = 1
    return size, np.packbits(bits, bitorder="little").tobytes()


def word_counts(train: DataFrame) -> DataFrame:
    """Exact counts ``(hash, n)`` of the tokens of ``train(text)``; tasks add up their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            texts = [_raw(t) for t in batch.column("text").to_pylist()]
            for begin, end in lots([len(t) for t in texts], AT_ONCE):
                keys, n = np.unique(tokens(texts[begin:end])[0], return_counts=True)
                held.append((keys, n))
            if sum(len(k) for k, _ in held) > POSTINGS:
                yield flush()
        if held:
            yield flush()

    return train.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def pair_blocks(train: DataFrame, words: DataFrame, blocks: int, cutoff: int = CUTOFF) -> DataFrame:
    """The filter's blocks ``(block, bits, again, data)``: pairs counted ``cutoff`` times or more, and all words.

    ``again`` counts the occurrences of pairs after their first.

    Tasks send each block one run of sorted keys (their low 40 bits, which within a block tell them apart) with counts.
    """

    def packed(block: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, block))
        block, keys, n = block[order], keys[order], n[order].astype("<i8")
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
        small = (keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).copy()
        rows = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            c = n[low:high]
            big = np.flatnonzero(c > 254)
            rows.append((int(block[low]), small[low:high].tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes(), big.astype("<u4").tobytes(), c[big].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "keys", "n", "at", "large"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return packed(*spot(keys, blocks, False), n)

        for batch in batches:
            texts = [_raw(t) for t in batch.column("text").to_pylist()]
            for begin, end in lots([len(t) for t in texts], AT_ONCE):
                held.append(pairs(*tokens(texts[begin:end])))
                if sum(map(len, held)) > POSTINGS:
                    yield flush()
        if held:
            yield flush()

    def post_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(*spot(mixed(batch.column("hash").to_numpy().view(np.uint64)), blocks, True), batch.column("n").to_numpy())

    def build(key: tuple, group: pa.Table) -> pa.Table:
        def wide(col: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(group.column(col).to_pylist()), dtype=kind)

        small = wide("keys", np.uint8).reshape(-1, 5)
        keys = np.zeros((len(small), 8), dtype=np.uint8)
        keys[:, :5] = small
        n = wide("n", np.uint8).astype(np.int64)
        shift = np.repeat(np.cumsum([0, *map(len, group.column("n").to_pylist())])[:-1], [len(a) // 4 for a in group.column("at").to_pylist()])
        n[wide("at", "<u4").astype(np.int64) + shift] = wide("large", "<i8")
        keys, inverse = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        n = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
        is_word = keys >= np.uint64(1 << 39)
        keep = is_word | (n >= cutoff)
        size, data = _bits(keys[keep], n[keep])
        again = int(np.maximum(n[~is_word] - 1, 0).sum())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([size], pa.int64()), "again": pa.array([again], pa.int64()), "data": pa.array([data], pa.binary())})

    kinds = "block long, keys binary, n binary, at binary, large binary"
    posted = train.select("text").mapInArrow(post, kinds).union(words.mapInArrow(post_words, kinds))
    return posted.groupBy("block").applyInArrow(build, "block long, bits long, again long, data binary")


def _parts(stored: DataFrame, blocks: int, limit: int) -> Iterator[LogFilter]:
    """The filter as a whole, or in parts of about ``limit`` bytes that are in memory one at a time."""
    total = stored.agg(F.sum("bits")).first()[0] or 0
    n = max(1, math.ceil(total / 8 / limit))
    for part in range(n):
        sizes, data = np.zeros(blocks, dtype=np.int64), {}
        for r in stored.where(F.col("block") % n == part).toLocalIterator():
            sizes[r.block], data[r.block] = r.bits, r.data
        yield LogFilter(np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(data[k] for k in sorted(data)) or b"\0", dtype=np.uint8))


@dataclass
class Model:
    blocks: int
    tokens: int
    types: int
    weight: float  # of the pair estimate: how often a pair is one seen before

    def logs(self, pair: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each token from the levels of its pair, of itself and of the token before it."""
        alone = (LEVELS[word] + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        given = np.minimum(1.0, LEVELS[pair] / np.maximum(LEVELS[before], 1.0))
        return np.log10(self.weight * given + (1 - self.weight) * alone)


def _codes(part: LogFilter, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of each token's pair and of each token; every distinct one is probed once."""
    words, inverse = np.unique(h, return_inverse=True)
    both, back = np.unique(pairs(h, counts), return_inverse=True)
    return part.levels(both, False).astype(np.uint8)[back], part.levels(mixed(words), True).astype(np.uint8)[inverse]


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Score each whole text: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` is learned from as a whole. Tokens are words (A-Z in lower case, split at ASCII white space) and one end.
    ``n_known`` counts tokens that the training texts have; ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V +
    1))) with exact counts. ``score`` is the model's log10 probability: pair and word counts from the filter,
    interpolated with the share of pair occurrences that are repeats. A null text is an empty one and has the end alone;
    null ids and repeated rows are scored like any others; without training texts, nothing is known and all tokens are
    alike. Other columns are not read.

    Filters and word tables within ``limit`` bytes are broadcast. A larger filter is probed part by part, each part
    adding its levels to a written table; a larger word table is joined. Results are the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learned = train.select(F.col(text_col).alias("text"))
    words = written(word_counts(learned), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = max(1024, -(-n // BLOCK))
    stored = written(pair_blocks(learned, words, blocks), "filter")
    again = stored.agg(F.coalesce(F.sum("again"), F.lit(0))).first()[0]
    model = Model(blocks, n, v, min(0.95, max(0.0, again / max(n, 1))))
    small = v * 16 <= limit
    if small:
        table = words.select("hash", "n").toArrow()  # two numbers for a word, checked to be within the limit
        keys, times = (table.column(c).to_numpy() for c in ("hash", "n"))
        order = np.argsort(keys.view(np.uint64))
        exact = spark.sparkContext.broadcast((keys.view(np.uint64)[order], times[order]))
        del table, keys, times, order
    parts = _parts(stored, blocks, limit)
    part, following = next(parts), next(parts, None)
    if not small:  # 128 bits of the id and the text name a row: null and repeated ids may have other texts
        rows = rows.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("text"), F.col("text"), F.lit("id"), F.col("doc_id")).alias("k2"))
    names = [] if small else ["k1", "k2"]
    kinds = "".join(f", {c} long" for c in names)
    coded = rows.withColumn("codes", F.lit(None).cast("binary"))

    def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        texts = [_raw(t) for t in batch.column("text").to_pylist()]
        for begin, end in lots([len(t) for t in texts], AT_ONCE):
            yield begin, end, *tokens(texts[begin:end])

    def levels(held, batch: pa.RecordBatch, begin: int, end: int, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, word = _codes(held.value, h, counts)
        old = [c for c in batch.column("codes").slice(begin, end - begin).to_pylist() if c is not None]
        if old:
            both = np.frombuffer(b"".join(old), dtype=np.uint8).reshape(-1, 2)
            pair, word = pair + both[:, 0], word + both[:, 1]  # a key lies in one part only
        return pair, word

    while following is not None:
        held = spark.sparkContext.broadcast(part)

        def probe(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end, h, counts in texts_of(batch):
                    both = np.stack(levels(held, batch, begin, end, h, counts), axis=1)
                    codes = [c.tobytes() for c in np.split(both, np.cumsum(counts)[:-1])]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), batch.column("text").slice(begin, end - begin), pa.array(codes, pa.binary()), *(batch.column(c).slice(begin, end - begin) for c in names)], names=["doc_id", "text", "codes", *names])

        coded = written(coded.mapInArrow(probe, f"doc_id long, text string, codes binary{kinds}"), "codes")
        part, following = following, next(parts, None)
    held = spark.sparkContext.broadcast(part)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, h, counts in texts_of(batch):
                pair, word = levels(held, batch, begin, end, h, counts)
                firsts = np.cumsum(counts) - counts
                before = np.r_[0, word[:-1]].astype(np.uint8)
                before[firsts] = int(held_start)
                sums = lambda x: np.add.reduceat(x, firsts)
                cols = [pa.array(counts), pa.array(sums(model.logs(pair, word, before)))]
                if small:
                    keys, n_of = exact.value
                    own, inverse = np.unique(h, return_inverse=True)
                    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    c = np.where(keys[at] == own, n_of[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                    logs = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                    cols += [pa.array(sums((c > 0)[inverse].astype(np.int64))), pa.array(sums(logs[inverse]))]
                else:
                    cols += [pa.array(np.zeros(len(counts), np.int64)), pa.array(np.zeros(len(counts)))]
                cols += [batch.column(c).slice(begin, end - begin) for c in names]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), *cols], names=["doc_id", "n_tokens", "score", "n_known", "base_score", *names])

    ends = words.where(F.col("hash") == int(END.astype(np.int64) if END < 2**63 else int(END) - 2**64)).select("n").first()
    held_start = level(np.array([ends.n if ends else 0]))[0]
    out = coded.mapInArrow(final, f"doc_id long, n_tokens long, score double, n_known long, base_score double{kinds}")
    if not small:
        out = out.drop("n_known", "base_score").join(_by_join(rows, words, n, v), ["k1", "k2"])
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _by_join(rows: DataFrame, words: DataFrame, n: int, v: int) -> DataFrame:
    """Exact counts ``(k1, k2, n_known, base_score)`` by a join on words, for tables that are too large to broadcast."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_raw(t) for t in batch.column("text").to_pylist()]
            for begin, end in lots([len(t) for t in texts], AT_ONCE):
                h, counts = tokens(texts[begin:end])
                owner = np.repeat(np.arange(end - begin), counts)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, end - begin).take(pa.array(owner[first])) for c in ("k1", "k2")), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)]))], names=["k1", "k2", "hash", "times"])

    each = rows.dropDuplicates(["k1", "k2"]).mapInArrow(spread, "k1 long, k2 long, hash long, times long").join(words, "hash", "left")
    c = F.coalesce("n", F.lit(0))
    return each.groupBy("k1", "k2").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("base_score"))
