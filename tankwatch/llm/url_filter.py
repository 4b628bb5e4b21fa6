"""URL filtering with a Bloom filter cascade.

A listing of rules (host, path prefix, verdict) is encoded as alternating Bloom filters: level 0 holds the
listed keys, level 1 those other keys of the corpus that level 0 lets through, level 2 the listed keys that
level 1 lets through, and so on until nothing of the other kind passes. Every key that occurs in the corpus
took part in the building, so the answers for this corpus are exact, and pages are judged by probing the
broadcast filters, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwatch.llm.common import ascii_lower, discard, written

#: Listings whose filters would need more than this many bytes are matched by shuffled joins instead.
MAX_FILTER_BYTES = 64 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (host suffix + path prefix) keys that a rule could have, longest first; then the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.lit(lengths), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.reverse(F.array_sort(F.array_distinct(pairs))), lambda x: x["key"]))


class Bloom:
    """Bits as 64-bit words; a key is a pair of 64-bit hashes."""

    def __init__(self, n: int, rate: float, salt: int):
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2))) if n else 1
        self.hashes = min(self.hashes, 30)
        self.salt = salt
        self.words = np.zeros((self.bits + 63) // 64, dtype=np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = (h1 ^ np.uint64((self.salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
            a ^= a >> np.uint64(33)
            b = (h2 + np.uint64(self.salt)) * np.uint64(0xC4CEB9FE1A85EC53)
            b = (b ^ (b >> np.uint64(29))) | np.uint64(1)
            steps = np.arange(self.hashes, dtype=np.uint64)
            return (a[:, None] + steps[None, :] * b[:, None]) % np.uint64(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


def _built(keys: DataFrame, n: int, rate: float, salt: int) -> Bloom:
    """Each task turns its keys into set bits; words are OR-ed before and after the shuffle."""
    out = Bloom(n, rate, salt)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(out.places(*_pairs(batch)))
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask)], names=["word", "mask"])

    got = keys.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    for word, mask in got.toLocalIterator():  # at most the filter's own words
        out.words[word] = np.uint64(mask & (2**64 - 1))
    return out


def _passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(bloom)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(*_pairs(batch))))

    return keys.mapInArrow(keep, "h1 long, h2 long")


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def filter_bytes(listed: int, others: int) -> int:
    """Upper estimate of a cascade's size: level 0 at its rate, then levels of about 0.7 listed keys at 1/2."""
    ratio = max(2.0, math.sqrt(2) * max(others, 1) / max(listed, 1))
    return int(listed * (1.4427 * math.log2(ratio) + 8) / 8) + 1024


def cascade(listed: DataFrame, others: DataFrame) -> list[Bloom]:
    """Filters for ``listed(h1, h2)`` against ``others(h1, h2)``; the two share no key."""
    own, rest = written(listed, "listed"), written(others, "others")
    sides, counts, levels, spent = [own, rest], [own.count(), rest.count()], [], [own, rest]
    rate = min(0.5, counts[0] * math.sqrt(0.5) / max(counts[1], 1)) if counts[0] else 0.5
    kind = 0
    while counts[kind]:
        levels.append(_built(sides[kind], counts[kind], rate if not levels else 0.5, len(levels) + 1))
        other = 1 - kind
        sides[other] = written(_passing(sides[other], levels[-1]), f"pass{len(levels)}")
        spent.append(sides[other])
        counts[other] = sides[other].count()
        kind = other
        if len(levels) > 200:
            raise RuntimeError("the cascade does not end: a key is on both sides")
    discard(*spent)
    return levels


def member(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for all keys that took part in ``cascade``: the first level that rejects decides."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = level.holds(h1[open_], h2[open_])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    return out


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Judge every url by ``rules(host, path, verdict)``; verdict is ``block`` or ``allow``.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule
    (host and path together, then the longer host) wins; without one, ``default`` holds. Adds ``host``,
    ``path``, ``rule`` (null without one) and ``verdict`` to the columns of ``pages``, replacing columns of
    those names; any other columns stay. A null url, or one without ``://``, has empty host and path and no rule. Rules that are
    repeated count once; if one is listed with both verdicts, ``block`` holds. Empty tables are fine.

    The filters' size follows the listing and is checked before building; above ``max_filter_bytes`` the
    keys are matched by a shuffled join, with the same result.
    """
    spark: SparkSession = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    keyed = pages.withColumns({"host": host, "path": path})
    spare = lambda name: name if name not in keyed.columns else spare(f"_{name}")
    keys_col, hit_col = spare("_keys"), spare("_hit")
    tidy = rules.select(F.concat(ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), (F.col("verdict") == "block").cast("int").alias("blocked"))
    listing = written(tidy.groupBy("key", "n").agg(F.max("blocked").alias("blocked")), "rules")
    lengths = [r.n for r in listing.select("n").distinct().orderBy("n").collect()]  # no more than the longest path has characters
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    h1, h2 = hashed(F.col("key"))
    universe = keyed.select("host", "path").select(F.explode(keys).alias("key")).distinct()
    n = listing.count()
    others = universe.join(listing.select("key"), "key", "left_anti").select(h1.alias("h1"), h2.alias("h2"))
    if filter_bytes(n, others.count() if n else 0) > max_filter_bytes:
        return _by_join(keyed, listing, keys, default, hit_col)
    listed = cascade(listing.select(h1.alias("h1"), h2.alias("h2")), others)
    blocked = cascade(listing.where("blocked = 1").select(h1.alias("h1"), h2.alias("h2")), listing.where("blocked = 0").select(h1.alias("h1"), h2.alias("h2")))
    discard(listing)
    held = spark.sparkContext.broadcast((listed, blocked))

    @F.pandas_udf("struct<place:int, blocked:boolean>")
    def probe(a, b):
        import pandas as pd

        sizes = np.fromiter((0 if x is None else len(x) for x in a), dtype=np.int64, count=len(a))
        flat1 = np.concatenate([np.asarray(x, dtype=np.int64) for x in a if x is not None] or [np.zeros(0, np.int64)]).view(np.uint64)
        flat2 = np.concatenate([np.asarray(x, dtype=np.int64) for x in b if x is not None] or [np.zeros(0, np.int64)]).view(np.uint64)
        in_list, in_block = held.value
        found = np.flatnonzero(member(in_list, flat1, flat2)) if len(flat1) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)[found]
        rows, first = np.unique(owner, return_index=True)
        place, is_blocked = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), bool)
        starts = np.cumsum(sizes) - sizes
        place[rows] = found[first] - starts[rows] + 1
        if len(rows):
            is_blocked[rows] = member(in_block, flat1[found[first]], flat2[found[first]])
        return pd.DataFrame({"place": place, "blocked": is_blocked})

    probed = keyed.withColumn(keys_col, keys).withColumn(hit_col, probe(F.transform(keys_col, lambda k: F.xxhash64(k)), F.transform(keys_col, lambda k: F.xxhash64(k, F.lit("second")))))
    place, in_block = F.col(hit_col).getField("place"), F.col(hit_col).getField("blocked")
    rule = F.when(place > 0, F.get(F.col(keys_col), place - 1))
    verdict = F.when(place > 0, F.when(in_block, F.lit("block")).otherwise(F.lit("allow"))).otherwise(F.lit(default))
    return probed.withColumns({"rule": rule, "verdict": verdict}).drop(keys_col, hit_col)


def _by_join(keyed: DataFrame, listing: DataFrame, keys: Column, default: str, best_col: str) -> DataFrame:
    """For listings whose filters are too large to broadcast: distinct (host, path prefix) keys are joined."""
    spots = keyed.select("host", "path").distinct()
    best = (
        spots.select("host", "path", F.posexplode(keys).alias("place", "key"))
        .join(listing.select("key", "blocked"), "key")
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("key", "blocked"), "place").alias(best_col))
    )
    out = keyed.join(best, ["host", "path"], "left").select(*keyed.columns, best_col)
    found = F.col(best_col)
    verdict = F.when(found.isNull(), F.lit(default)).when(found.getField("blocked") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": found.getField("key"), "verdict": verdict}).drop(best_col)
