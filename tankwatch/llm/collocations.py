"""Phrase collocations by Rabin-Karp fingerprints.

A text becomes one array of bytes with a single space between words; a prefix polynomial over it gives the fingerprint
of every n-gram of any length by a subtraction and a product. Fingerprints are counted length by length: a phrase can only
be frequent if its two parts of one word less are, so a length is counted only where those passed. Counts of fingerprints
are never too small, so this screen loses nothing. A last pass keeps, for each fingerprint that passed, a pointer to one
occurrence, holds all its other occurrences against the text there, and only then writes that text out, to be counted as text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.llm.common import discard, key_filter, may_hold, written
from tankwatch.llm.wordhash import lots, mixed

#: Most words of a phrase, times it must occur, phrases reported for a language, and the share of a phrase's
#: occurrences, in percent, that lie in one longer phrase if the longer one replaces it.
WORDS, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: Bytes of texts that are hashed at once, and fingerprints that a task gathers before it passes them on.
AT_ONCE, ENTRIES = 1 << 20, 1 << 21
_STEP = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(29).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to lower case, and all that splits pieces to a line feed.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Grams:
    """The words of some texts, and the fingerprints of all their n-grams."""

    def __init__(self, texts: list[bytes], salts: np.ndarray, bits: int = 64):
        self.bits = bits
        raw = np.frombuffer(b"\n".join([b"", *(t.translate(_CLEAN) for t in texts), b""]), dtype=np.uint8)
        gap = (raw == 32) | (raw == 10)
        first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        # a word's bytes and one before them stay, so that words of a piece are one space apart
        keep = ~gap
        keep[first - 1] = True
        place = np.cumsum(keep) - 1
        self.flat = np.where(gap, np.uint8(32), raw)[keep]
        last = np.flatnonzero(~gap[:-1] & gap[1:])
        self.start, self.end = place[first], place[last] + 1
        self.piece = np.cumsum(raw == 10)[first]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        self.owner = np.searchsorted(ends, first, side="left")
        self.salt = salts[self.owner]
        up, self.down = _powers(1 << max(16, len(self.flat).bit_length()))
        self.prefix = np.zeros(len(self.flat) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.flat] * up[: len(self.flat)], out=self.prefix[1:])

    def places(self, n: int) -> np.ndarray:
        """First words of all n-grams that lie within a piece."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        begin, end = self.start[at], self.end[at + n - 1]
        h = mixed(mixed((self.prefix[end] - self.prefix[begin]) * self.down[begin] + (end - begin).astype(np.uint64)) + self.salt[at])
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def screened(self, n: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the n-grams whose two parts of one word less may be frequent."""
        at = self.places(n)
        if n > 1:
            for part in (0, 1):
                at = at[may_hold(bits, self.fingerprints(at + part, n - 1))]
        return at, self.fingerprints(at, n)


def _in_lots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Grams, list[str]]]:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        salts = np.fromiter((xxhash.xxh64_intdigest(x) for x in langs), dtype=np.uint64, count=len(langs))
        for begin, end in lots([len(t) for t in texts], AT_ONCE):
            yield Grams(texts[begin:end], salts[begin:end], bits), langs[begin:end]


def _counted(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fp, count, lang = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((fp, lang)) if lang.any() else np.argsort(fp, kind="stable")
    fp, count, lang = fp[order], count[order], lang[order]
    begin = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (lang[1:] != lang[:-1])]) if len(fp) else np.zeros(0, np.int64)
    return fp[begin], np.add.reduceat(count, begin) if len(begin) else count, lang[begin]


def _level(docs: DataFrame, n: int, shared, bits: int) -> DataFrame:
    """``fp, count`` of all n-grams that pass the screen, summed within tasks; with ``lang`` for single words."""

    def run(batches):
        screen, known, held = (None if shared is None else shared.value), {}, []

        def out():
            fp, count, lang = _counted(held)
            held.clear()
            names = np.array([*known, None], dtype=object)
            columns = {"fp": pa.array(fp), "count": pa.array(count)} | ({"lang": pa.array(names[lang], pa.string())} if n == 1 else {})
            return pa.RecordBatch.from_pydict(columns)

        for grams, langs in _in_lots(batches, bits):
            at, fp = grams.screened(n, screen)
            codes = np.fromiter((known.setdefault(x, len(known)) for x in langs), dtype=np.int32, count=len(langs)) if n == 1 else np.zeros(len(langs), np.int32)
            held.append(_counted([(fp, np.ones(len(fp), np.int64), codes[grams.owner[at]])]))
            if sum(len(h[0]) for h in held) > ENTRIES:
                held[:] = [_counted(held)]
                if len(held[0][0]) > ENTRIES // 2:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "fp long, count long" + (", lang string" if n == 1 else ""))


def _verified(grams: Grams, at: np.ndarray, fp: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """For each fingerprint of a language a place, its count, and its text; occurrences whose text is another are counted apart."""
    order = np.lexsort((grams.salt[at], fp))
    at, fp = at[order], fp[order]
    salt = grams.salt[at]
    head = np.r_[True, (fp[1:] != fp[:-1]) | (salt[1:] != salt[:-1])] if len(fp) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    pointer = at[head][group]  # one occurrence for all of a fingerprint
    begin, size = grams.start[at], grams.end[at + n - 1] - grams.start[at]
    theirs, length = grams.start[pointer], grams.end[pointer + n - 1] - grams.start[pointer]
    same = size == length
    k = np.flatnonzero(same)
    edge = np.cumsum(size[k])
    if len(k):
        step = np.arange(edge[-1]) - np.repeat(edge - size[k], size[k])
        differ = grams.flat[np.repeat(begin[k], size[k]) + step] != grams.flat[np.repeat(theirs[k], size[k]) + step]
        same[k] = ~np.logical_or.reduceat(differ, edge - size[k])
    flat = grams.flat.tobytes()
    text = lambda i: flat[grams.start[i] : grams.end[i + n - 1]]
    counts = np.bincount(group[same], minlength=int(head.sum())).tolist() if len(fp) else []
    out = [(i, c, text(i)) for i, c in zip(at[head].tolist(), counts, strict=True)]
    others = Counter((int(grams.owner[i]), text(i)) for i in at[~same].tolist())
    first = {(int(grams.owner[i]), text(i)): i for i in at[~same].tolist()}
    return out + [(first[x], c, x[1]) for x, c in others.items()]


def _texts(docs: DataFrame, words: int, shared: list, bits: int) -> DataFrame:
    """``lang, phrase, words, count``: phrases whose fingerprint may be frequent, with their text, by lot."""

    def run(batches):
        screens = [x.value for x in shared]
        for grams, langs in _in_lots(batches, bits):
            for n in range(1, words + 1):
                at = grams.places(n)
                fp = grams.fingerprints(at, n)
                some = may_hold(screens[n - 1], fp)
                rows = _verified(grams, at[some], fp[some], n)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([langs[grams.owner[i]] for i, _, _ in rows], pa.string()), "phrase": pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string()), "words": pa.array([n] * len(rows), pa.int32()), "count": pa.array([c for _, c, _ in rows], pa.int64())}
                )

    return docs.mapInArrow(run, "lang string, phrase string, words int, count long")


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, bits: int = 64, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables ``lang, phrase, words, a`` of all phrases of 1 to ``words`` words that occur ``least`` times or more, and ``lang, n``.

    ``bits`` is the width of the fingerprints; counts are exact at any width, since they are taken from texts in the end.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared, n_by_lang = [], None
    for n in range(1, words + 1):
        level = _level(rows, n, shared[-1] if shared else None, bits)
        if n == 1:
            singles = written(level.groupBy("lang", "fp").agg(F.sum("count").alias("count")), "single-words")
            n_by_lang = written(singles.groupBy("lang").agg(F.sum("count").alias("n")), "words-of-languages")
            level = singles
        frequent = written(level.groupBy("fp").agg(F.sum("count").alias("count")).where(F.col("count") >= least).select("fp"), f"frequent-{n}")
        if n == 1:
            discard(singles)
        shared.append(spark.sparkContext.broadcast(key_filter(frequent, "fp", hashed=True)))
        discard(frequent)
    found = _texts(rows, words, shared, bits).groupBy("lang", "phrase", "words").agg(F.sum("count").alias("a"))
    out = written(found.where(F.col("a") >= least), "phrases")
    for x in shared:
        x.unpersist()
    return out, n_by_lang


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, covered: int = COVERED, bits: int = 64, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The phrases of 2 to ``words`` words that hold together best: ``lang, rank, phrase, a, l, r, n, score, words, cut``.

    A-Z are lower-cased, texts end pieces at ``. , ; : ! ?`` and line ends, and words of a piece are told apart by spaces and
    tabs. ``a`` counts a phrase's occurrences within pieces (overlaps too), ``l`` and ``r`` those of its parts at the cut that gives
    the lowest ``score = floor(2000000 a / (l + r))`` (then the first cut, ``cut`` words long), ``n`` all words of the language. A
    phrase is left out if ``covered`` percent of its occurrences or more lie in one longer phrase that occurs ``least`` times. Each language's
    first ``top`` are returned by score, ``a`` (both falling), and phrase in byte order.

    A null language is ``und``; null, empty and blank texts have no words; repeated rows and copies count as often as they
    occur; an empty table gives an empty result. Ids and other columns are not read. Longer texts are not cut.
    """
    phrases, n_by_lang = phrase_counts(docs, words, least, bits, lang_col, text_col)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    split = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    piece = lambda k, m: F.array_join(F.slice("w", k, m), " ")
    cuts = split.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", piece(F.lit(1), F.col("cut")).alias("left"), piece(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + r)"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # what lies in a longer phrase: all its parts of two words or more, with the most frequent longer one
    spans = [(k, m) for m in range(2, words) for k in range(1, words - m + 2)]
    inner = split.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(*[F.when((F.lit(k + m - 1) <= F.col("words")) & (F.lit(m) < F.col("words")), piece(F.lit(k), F.lit(m))) for k, m in spans] or [F.lit(None).cast("string")])).alias("phrase"))
    longest = inner.where("phrase is not null").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered))
    rows = written(kept.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score", "x.cut"), "collocations")
    # two steps, so that no task sorts all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = rows.withColumn("_share", share).withColumn("_place", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_place") <= top).drop("_share", "_place")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = written(ranked.join(n_by_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut"), "ranked")
    discard(phrases, n_by_lang, rows)
    return out
