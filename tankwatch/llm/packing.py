"""Packing documents into training sequences with shortest-pack-first over the length histogram.

Texts are tokenised and cut into pieces of at most one sequence. Only the histogram of piece lengths (one entry
for each possible length) reaches the driver; there lengths are placed longest first, each into the packing
patterns with the most room, with counts instead of single pieces. Pieces find their place in a pattern by their
rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.llm.common import written

#: Words whose ids a Python worker remembers between batches, and text bytes that are tokenised at once.
CACHE, AT_ONCE = 700_000, 4 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Fixed values of the vocabulary's own splitting rule, for the plain words below.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Words of printable ASCII and Latin-1 letters; all others, and those with a special token's mark, go the long way.
_PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+", re.DOTALL)
_PROBE = ["The", "naïve,", "don't", "x9$$$", "ÜBER!!", "it's", "çà42", "STRASSE-ß", "a_b", "(ÿ)"]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell Latin-1 letters: printable bytes as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {c: "".join(chr(hidden.get(b, b)) for b in chr(c).encode()) for c in range(192, 256)}


class WordIds:
    """Token ids word by word: no token of this kind of vocabulary crosses ASCII white space.

    Plain words go straight to the vocabulary's merges, which saves the general normaliser's cost. On a
    vocabulary with other rules, found out by a few probe words, every word takes the tokenizer's whole way.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.end_id = end_id
        self.letters = _byte_letters()
        self.clear()
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(_PROBE, add_special_tokens=False)]
        try:
            self.straight = all(self._plain(w) == ids for w, ids in zip(_PROBE, whole, strict=True))
        except Exception:  # a model without merges of its own raises what it likes; the whole way is always right
            self.straight = False

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.known: dict[str, list[int]] = {}
        self.flat, self.sizes = array("I", [self.end_id]), array("q", [1])

    def _plain(self, word: str) -> list[int]:
        out: list[int] = []
        for part in _SPLIT.findall(word.lower()):
            ids = self.known.get(part)
            if ids is None:
                ids = self.known[part] = [t.id for t in self.tokenizer.model.tokenize(part if part.isascii() else part.translate(self.letters))]
            out += ids
        return out

    def _add(self, word: bytes, ids: list[int]) -> None:
        self.index[word] = len(self.sizes)
        self.flat.extend(ids)
        self.sizes.append(len(ids))

    def add(self, new: list[bytes]) -> None:
        odd = []
        for word in new:
            text = word.decode("utf-8", "replace")
            if self.straight and _PLAIN.fullmatch(text):
                self._add(word, self._plain(text))
            else:
                odd.append(word)
        for at in range(0, len(odd), 5_000):
            part = odd[at : at + 5_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self._add(word, got.ids)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by the end id; and where the texts end."""
        if len(self.index) > CACHE or len(self.known) > CACHE:
            self.clear()
        split = [t.split() for t in texts]
        self.add(list(set().union(*split).difference(self.index)) if split else [])
        get = self.index.__getitem__
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        order = np.fromiter(map(get, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        order = np.insert(order, np.cumsum(counts), 0)  # index 0 holds the end id
        sizes, flat = np.array(self.sizes, dtype=np.int64), np.array(self.flat, dtype=np.uint32)
        begins = np.cumsum(sizes) - sizes
        take = sizes[order]
        ends = np.cumsum(take)
        ids = flat[np.repeat(begins[order] - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, ends[order == 0]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens``. A null text is an empty one."""
    with open(tokenizer_path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(held.value, end_id)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([len(t) for t in texts]) // AT_ONCE
            for lot in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                ids, ends = ids_of.of([texts[k] for k in lot])
                rows = []
                for k, low, high in zip(lot.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    for at in range(low, high, capacity):
                        upto = min(at + capacity, high)
                        rows.append((k, at - low, upto - at, zlib.crc32(ids[at:upto].astype("<u4").tobytes()), high - low))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, _PIECES)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns. Longest lengths first; each goes to the emptiest packs that have room."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:  # new packs take this length as often as it fits
                fits = capacity // length
                for count, times in ((left // fits, fits), (min(1, left % fits), left % fits)):
                    if count:
                        by_room.setdefault(capacity - times * length, []).append((count, (length,) * times))
                break
            count, pack = by_room[room].pop()
            used = min(count, left)
            if used < count:
                by_room[room].append((count - used, pack))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append((used, (*pack, length)))
            left -= used
    return [(count, pack) for room in sorted(by_room) for count, pack in by_room[room]]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset of its pieces."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in found:
        offset = 0
        for length in pack:
            rank = next_rank.get(length, 0)
            rows.append(((length << 44) + rank, sequence - rank, offset))
            next_rank[length] = rank + count
            offset += length
        sequence += count
    out = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return out[:, 0].copy(), out[:, 1].copy(), out[:, 2].copy()


def ranked(df: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """Adds ``rank``, counted from 0 within ``key``, without gathering a key's rows in one task.

    Rows of a key are dealt over ``buckets``; a bucket's counts give the rank that it starts from.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    begin = counts.withColumn("_at", F.sum("_n").over(W.partitionBy(key).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)) - 1
    return dealt.withColumn("_r", inside).join(begin, [key, "_b"]).withColumn("rank", F.col("_at") + F.col("_r")).drop("_b", "_r", "_at")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """Every token id of every document in exactly one piece, with its sequence and its place there.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Sequences hold at most
    ``capacity`` ids, without gaps from 0. A document's ids are its text's, closed by ``end_id``; a null or empty
    text has that id alone, and a document longer than a sequence is cut at multiples of ``capacity``. Repeated
    rows and null ids are packed like any others; an empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    held = docs.sparkSession.sparkContext.broadcast(slots(patterns(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = held.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[at] + rank), pa.array(offset[at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked(cut, "length", ["doc_id", "start", "ids_crc32"], buckets).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
