"""Language identification by compression.

For each language, a zstandard compressor gets that language's text as a raw-content dictionary. A text is
compressed with every one of them; the smallest result names the language, and a narrow margin rejects it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitting sample: documents for each language, and bytes of each language's dictionary.
SAMPLE_DOCS, DICT_BYTES = 256, 112 << 10
#: Texts are compressed in pieces of this many bytes, so that a long text keeps leaning on the dictionary.
PIECE = 2048
MAX_LANGUAGES = 256


def canonical(text: Column) -> Column:
    """Letters in lower case, with one space for each run of anything else: marks and digits name no language."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))


def fit_dictionaries(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from at most about ``sample_docs`` texts for each, chosen by hash; of each, about
    ``dict_bytes / sample_docs`` bytes of letters from its middle.

    Counts by language are of different texts and come from all rows; they fix a language's sampling rate, so that
    copies neither crowd the dictionary nor reach the driver. Rows without language or without a letter are not used.
    More than ``MAX_LANGUAGES`` languages are an error, as each holds a dictionary in every task.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    share = dict_bytes // sample_docs
    # each sampled text gives a run of characters from its middle
    run = F.lit(share)
    begin = F.greatest(F.lit(1), F.floor((F.length("text") - run) / 2).cast("int"))
    got = rows.where(place < wanted[F.col("lang")]).select("lang", canonical(F.col("text")).alias("text")).select("lang", F.substring("text", begin, run).alias("part")).distinct().collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        parts = sorted({r.part for r in got if r.lang == lang})
        # every text gives its part, also where a letter takes several bytes
        each = dict_bytes // max(len(parts), 1) - 1
        out[lang] = b" ".join(p.encode("utf-8", "replace")[:each].decode("utf-8", "ignore").encode() for p in parts)
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 3, min_margin: float = 0.01, scale_bits: float = 96.0) -> DataFrame:
    """One row for each document: ``doc_id, lang_pred, accepted, margin, score, sizes``.

    ``sizes`` are the compressed bytes by language, ``margin`` is (second - best) / second, ``accepted`` tells
    whether it reaches ``min_margin``, and ``score`` is the best language's share when code lengths are read
    as log probabilities tempered by ``scale_bits``. Ties are settled by a
    finer match search, then by name. A null text, one
    without a letter, or an empty set of dictionaries gives ``und``, not accepted, score 0. The letters
    of whole texts are compressed, in pieces of 2 KiB. Repeated rows give repeated results; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    finer = 8
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        langs = sorted(held.value)

        def packers(level: int, strategy: int) -> list:
            out = []
            for lang in langs:
                params = zstandard.ZstdCompressionParameters(compression_level=level, window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=4, strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(held.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
            return out

        quick, slow = packers(level, zstandard.STRATEGY_GREEDY), []
        for batch in batches:
            pred, accepted, margins, scores, sizes = [], [], [], [], []
            for text, has in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
                raw = text.as_buffer() if has and langs else None
                if raw is None:
                    pred.append("und"), accepted.append(False), margins.append(0.0), scores.append(0.0), sizes.append([])
                    continue
                view = memoryview(raw)
                pieces = [view[i : i + PIECE] for i in range(0, len(view), PIECE)]
                size = [sum(len(p.compress(x)) for x in pieces) for p in quick]
                if size.count(min(size)) > 1:
                    slow = slow or packers(finer, zstandard.STRATEGY_BTLAZY2)
                    size = [sum(len(p.compress(x)) for x in pieces) for p in slow]
                order = sorted(range(len(langs)), key=lambda i: (size[i], i))
                best = size[order[0]]
                second = size[order[1]] if len(order) > 1 else best * 2
                pred.append(langs[order[0]])
                margins.append((second - best) / second)
                accepted.append(margins[-1] >= min_margin)
                scores.append(1 / sum(math.exp(-(s - best) * 8 * math.log(2) / scale_bits) for s in size))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(accepted, pa.bool_()), pa.array(margins, pa.float64()), pa.array(scores, pa.float64()), pa.array(sizes, pa.list_(pa.int64()))], names=["doc_id", "lang_pred", "accepted", "margin", "score", "sizes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, accepted boolean, margin double, score double, sizes array<long>")
