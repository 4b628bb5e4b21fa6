"""Substring deduplication on a log-structured index of window fingerprints.

Documents come in batches by rising id. A batch's fingerprints (the smallest of every nine consecutive five-word
hashes, so that equal 13-word windows have equal fingerprints) form a sorted immutable run, bucketed by hash, which
is merge-joined with the runs of earlier batches; runs are compacted when there are too many. Only windows around
fingerprints that two documents share are then verified, by the hash of all their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwatch.llm.common import discard, shared_dir, written
from tankwatch.llm.wordhash import lots, mixed, rolling, word_hashes

#: Words of a window, of a hashed gram, and grams among which a window's smallest is taken.
WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
AT_ONCE = 1 << 20


def smallest_grams(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all texts: the text's number, the begin in ``h``, and the smallest gram hash."""
    grams = mixed(rolling(h, GRAM) + np.uint64(0x51ED270B))
    n = np.maximum(counts - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    begins = np.cumsum(counts) - counts
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begins[owner]
    least = grams[: max(len(grams) - SPAN + 1, 0)].copy()
    for k in range(1, SPAN):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return owner, at, least[at]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(w), hashlib.sha256(b" ".join(w)).hexdigest()) for t in _texts(batch) for w in (t.split(),)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text", "n_words", "whole"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = _texts(batch), batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for begin, end in lots([len(t) for t in texts], AT_ONCE):
            h, counts = word_hashes(texts[begin:end])
            owner, _, least = smallest_grams(h, counts)
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])] if len(owner) else np.zeros(0, bool)
            owner, least = owner[fresh], least[fresh]
            order = np.lexsort((least, owner))
            owner, least = owner[order], least[order]
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])] if len(owner) else fresh
            yield pa.RecordBatch.from_arrays([pa.array(least[fresh].view(np.int64)), pa.array(ids[begin:end][owner[fresh]])], names=["hash", "doc_id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose fingerprint is among the document's shared ones."""
    for batch in batches:
        texts, ids, shared = _texts(batch), batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("shared")
        for begin, end in lots([len(t) for t in texts], AT_ONCE):
            h, counts = word_hashes(texts[begin:end])
            owner, at, least = smallest_grams(h, counts)
            edges = np.searchsorted(owner, np.arange(end - begin + 1))
            keep = np.zeros(len(owner), dtype=bool)
            for k in range(end - begin):
                marks = shared[begin + k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                keep[edges[k] : edges[k + 1]] = np.isin(least[edges[k] : edges[k + 1]], marks)
            whole, starts = rolling(h, WINDOW), np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([pa.array(whole[at[keep]].view(np.int64)), pa.array(ids[begin:end][owner[keep]]), pa.array((at[keep] - starts[owner[keep]]).astype(np.int32))], names=["window", "doc_id", "place"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, n, whole, first, doc, places in zip(_texts(batch), batch.column("n_words").to_pylist(), batch.column("whole").to_pylist(), batch.column("first").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("places"), strict=True):
            if first is not None and doc is not None and first < doc and n >= WINDOW:
                out.append((n, n, ""))
            elif places.is_valid:
                at = places.values.to_numpy(zero_copy_only=False).astype(np.int64)
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                gone = np.cumsum(step[:n]) > 0
                out.append((n, int(gone.sum()), b" ".join(w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g).decode("utf-8", "replace")))
            else:
                out.append((n, 0, None))
        sums = [w if o[2] is None else hashlib.sha256(o[2].encode()).hexdigest() for w, o in zip(batch.column("whole").to_pylist(), out, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array(sums, pa.string()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


class FingerprintIndex:
    """Sorted immutable runs ``(hash, doc_id)``, bucketed by hash: joins between them shuffle nothing."""

    def __init__(self, spark: SparkSession, buckets: int, max_runs: int = 4):
        self.spark, self.buckets, self.max_runs = spark, buckets, max_runs
        self.home = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.tables: list[str] = []

    def store(self, df: DataFrame, key: str, ordered: bool = True) -> str:
        """``df`` as a table bucketed by ``key``, one file for each bucket, sorted unless rows are wide."""
        name = f"tankwatch_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, key)
        out = (df.sortWithinPartitions(key) if ordered else df).write.option("path", f"{self.home}/{name}").option("compression", "zstd").bucketBy(self.buckets, key)
        (out.sortBy(key) if ordered else out).saveAsTable(name)
        self.tables.append(name)
        return name

    def add(self, fingerprints: DataFrame) -> str:
        """Append a batch as a run; returns the table of its hashes that another document has as well."""
        run = self.store(fingerprints, "hash")
        new = self.spark.table(run)
        within = new.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("hash")
        for old in self.runs:
            within = within.union(new.select("hash").join(self.spark.table(old).select("hash"), "hash", "left_semi"))
        shared = self.store(within.distinct(), "hash")
        self.runs.append(run)
        if len(self.runs) > self.max_runs:
            self.compact()
        return shared

    def compact(self) -> None:
        """All runs as one; the old ones go."""
        merged = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            merged = merged.union(self.spark.table(run))
        new = self.store(merged.distinct(), "hash")
        self.drop(self.runs)
        self.runs = [new]

    def drop(self, tables: list[str]) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in list(tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}"), True)
            if name in self.tables:
                self.tables.remove(name)


def substring_dedup(docs: DataFrame, batches: int = 6, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of every 13-word window that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept``: ``kept`` is the remaining words joined by one space, or
    null where nothing was removed. Windows are judged on the input, not on what is left; words are runs without ASCII
    white space, unchanged. Null, empty and short texts lose nothing. Rows with a null id lose nothing and cause no
    removal; rows that share an id are copies of one document, which is indexed by the text with the least hash of its words. Other columns are not read. Windows are told apart by a
    64-bit hash of their words, next to the fingerprint's.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_doc = FingerprintIndex(spark, index.buckets)  # fewer buckets than shuffle partitions would be dealt anew by every join
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the texts are shuffled this once; all joins with them below find them dealt by id
    base = spark.table(by_doc.store(rows.mapInArrow(_survey, "doc_id long, text string, n_words long, whole string"), "doc_id", ordered=False))
    # of equal texts the first alone is indexed: all windows of the others start in it as well
    firsts = written(base.where("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "firsts")
    leading = firsts.select(F.col("first").alias("doc_id")).distinct()
    cuts = base.where("doc_id is not null").select(F.percentile_approx("doc_id", F.array(*[F.lit(k / batches) for k in range(1, batches)]), 1000).alias("at")).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    shared = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = base.where(f"n_words >= {WINDOW}")
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        # of different texts with one id, the one with the least hash is the document
        new = part.join(leading, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", "whole").alias("text"))
        shared.append(index.add(new.mapInArrow(_fingerprints, "hash long, doc_id long")))
    common = spark.table(shared[0])
    for name in shared[1:]:
        common = common.union(spark.table(name))
    common = spark.table(index.store(common.distinct(), "hash"))
    marks = None
    for run in index.runs:
        found = spark.table(run).join(common, "hash", "left_semi")
        marks = found if marks is None else marks.union(found)
    marked = marks.groupBy("doc_id").agg(F.collect_list("hash").alias("shared"))
    windows = written(base.select("doc_id", "text").join(marked, "doc_id").mapInArrow(_windows, "window long, doc_id long, place int"), "windows")
    # a window's first document by partial minima: a passage that very many documents share is no large group
    owners = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("window", "owner")
    owned = windows.join(owners, "window").where("owner < doc_id").select("doc_id", "place")
    hits = written(owned.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "hits")
    discard(windows)
    copies = base.join(firsts.where("first <> last").select("whole", "first"), "whole").select("doc_id", "first").where("first < doc_id").distinct()
    judged = base.join(hits, "doc_id", "left").join(copies, "doc_id", "left").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = written(judged, "substrings")
    index.drop(index.tables)
    by_doc.drop(by_doc.tables)
    discard(firsts, hits)
    return out
