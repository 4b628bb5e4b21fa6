"""Benchmark decontamination on templates, with DataFrame functions only.

Numbers, names and units become typed placeholders; windows of the resulting templates are hash-joined with the
benchmark's, and the values behind the placeholders must correspond one to one. So a question is also found when
its numbers or names were exchanged. What matches word for word counts without regard to placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import written

#: Words in a window, plain words from which on its values may be others, the share of an item's windows to be
#: found, and the verbatim words in a row that are enough.
WINDOW, LITERALS, COVERAGE, RUN = 8, 4, 0.5, 13
#: Benchmarks of up to this many windows are broadcast; larger ones are joined by shuffling.
BROADCAST_WINDOWS = 500_000
_UNITS = "kg mg km cm mm ml lb lbs oz mph kmh kwh hz ghz mhz percent dollar dollars euro euros cent cents pound pounds meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split()
_MARK = "\x01"


def marked_words(text: Column) -> Column:
    """Lower-case words without punctuation; a name keeps a mark in front, a number its digits in one word.

    A name is a capitalised word that no sentence end precedes.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, "")
    joined = F.regexp_replace(clean, r"(?<=\d)[.,:](?=\d)", "")
    named = F.regexp_replace(joined, r"(?<=[^\s.!?:]\s)(?=\p{Lu}\p{Ll}+(?!\p{L}))", _MARK)
    return F.filter(F.split(F.lower(F.regexp_replace(named, r"[^\p{L}\p{N}\x01\s]+", " ")), r"\s+"), lambda w: w != "")


def _kind(word: Column) -> Column:
    """0 for a word that stands for itself, else the type of its placeholder."""
    return F.when(word.startswith(_MARK), 1).when(word.substr(1, 1).between("0", "9"), 2).when(word.isin(_UNITS), 3).otherwise(0)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(_kind(w) == 0, F.xxhash64(w)).otherwise(_kind(w).cast("long")))


def _windows(size: Column, window: int) -> Column:
    """Begins, from 1, of all windows of ``window`` words."""
    return F.when(size >= window, F.sequence(F.lit(1), size - window + 1)).otherwise(F.array().cast("array<int>"))


def _slots(words: Column, place: Column, window: int) -> Column:
    return F.filter(F.slice(words, place, window), lambda w: _kind(w) != 0)


def _pattern(slots: Column) -> Column:
    """For each slot, where its value first stood: equal patterns mean that values correspond one to one."""
    return F.transform(slots, lambda s: F.array_position(slots, s))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, verbatim or with other values.

    Returns ``doc_id, item_id, n_windows, item_windows, verbatim``: how many of the item's windows were found word for
    word or with corresponding values, how many it has, and whether all that were found are word for word. A pair is
    reported from ``coverage`` of the item's windows on (of all, or of those with ``literals`` plain words), or from
    ``run`` words in a row that are the item's own. Windows with fewer than ``literals`` plain words are found word for
    word only. Values that do not correspond one to one leave out the windows that hold them, unless these match word
    for word. Items of fewer words than ``window`` count as one window of their own length. Null or empty texts and null
    ids hold nothing; repeated rows of an id count once; other columns are not read.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), marked_words(F.col(item_text_col)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    sized = items.withColumn("w", F.least(F.col("n"), F.lit(window)))
    spread = sized.select("item_id", "w", "words", _hashes(F.col("words")).alias("hashes"), F.explode(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)).alias("at"))
    own = spread.distinct().select("item_id", "w", "at", F.slice("hashes", F.col("at"), F.col("w")).alias("part"), F.slice("words", F.col("at"), F.col("w")).alias("own"), F.filter(F.slice("words", F.col("at"), F.col("w")), lambda x: _kind(x) != 0).alias("item_slots"))
    plain = F.size(F.filter("part", lambda h: ~h.isin(1, 2, 3))) >= F.least(F.lit(literals), F.col("w"))
    index = written(own.select("item_id", "w", "at", plain.alias("plain"), F.xxhash64("part").alias("hash"), F.xxhash64("own").alias("exact"), "item_slots"), "benchmark-windows")
    totals = index.groupBy("item_id").agg(F.count("*").alias("item_windows"), F.count_if("plain").alias("item_plain"))
    lengths = sorted(r.w for r in index.select("w").distinct().collect())  # at most `window` of them
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    worded = rows.select("doc_id", marked_words(F.col("text")).alias("words"))
    if not lengths:
        return worded.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("item_windows"), F.lit(True).alias("verbatim")).where(F.lit(False))
    hashed = worded.select("doc_id", "words", _hashes(F.col("words")).alias("hashes"))
    if lengths == [window]:  # the usual case needs no struct for each window
        spots = hashed.select("doc_id", "words", F.posexplode(F.transform(_windows(F.size("hashes"), window), lambda i: F.xxhash64(F.slice("hashes", i, window)))).alias("place", "hash")).select("doc_id", "words", F.lit(window).alias("w"), (F.col("place") + 1).alias("place"), "hash")
    else:
        spot = lambda w: lambda i: F.struct(F.lit(w).alias("w"), i.alias("place"), F.xxhash64(F.slice("hashes", i, w)).alias("hash"))
        every = F.flatten(F.array(*[F.transform(_windows(F.size("hashes"), w), spot(w)) for w in lengths]))  # a second argument of the inner one would be the index
        spots = hashed.select("doc_id", "words", F.explode(every).alias("s")).select("doc_id", "words", "s.w", "s.place", "s.hash")
    # one entry for a hash, however many items have it: the join with the documents then makes no copies
    keys = index.groupBy("hash", "w").agg(F.bool_or("plain").alias("plain"), F.collect_set(F.when(~F.col("plain"), F.col("exact"))).alias("exacts"))
    part = F.slice("words", F.col("place"), F.col("w"))
    slots = F.filter(part, lambda x: _kind(x) != 0).alias("slots")
    # a window of few plain words goes by the hash of the words themselves
    own_key = F.when(F.col("plain"), F.col("hash")).otherwise(F.xxhash64(part)).alias("key")
    fits = F.col("plain") | F.array_contains("exacts", F.xxhash64(part))
    if index.count() <= broadcast_windows:
        # windows meet the benchmark where they arise; only those that it has are ever moved
        met = spots.join(F.broadcast(keys), ["hash", "w"])
    else:
        hits = written(spots.drop("words").join(keys, ["hash", "w"]).distinct(), "hits")
        met = worded.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").join(hits, "doc_id")
    found = written(met.where(fits).select("doc_id", "place", "w", own_key, slots).distinct(), "found")
    keyed = index.withColumn("key", F.when(F.col("plain"), F.col("hash")).otherwise(F.col("exact")))
    pairs = found.join(keyed, ["key", "w"]).where(_pattern(F.col("slots")) == _pattern(F.col("item_slots")))
    values = F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))
    aligned = pairs.withColumns({"values": values, "same": F.col("slots") == F.col("item_slots")}).where("plain or same").groupBy("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(
        F.collect_set(F.struct("at", "plain", "same", "values")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("all"),
    )
    torn = lambda v: F.size(F.filter("all", lambda u: (u["theirs"] == v["theirs"]) | (u["ours"] == v["ours"]))) > 1
    fitting = aligned.withColumn("torn", F.filter("all", torn)).withColumn("windows", F.filter("windows", lambda x: x["same"] | ~F.arrays_overlap(x["values"], F.col("torn"))))
    at_of = lambda name: F.transform(F.filter("windows", lambda x: x[name]), lambda x: x["at"])
    step = max(run - window, 0)
    literal = F.col("literal")
    in_row = F.when(F.size(literal) > step, F.exists(F.sequence(F.lit(0), F.size(literal) - 1 - step), lambda i: F.get(literal, i + step) - F.get(literal, i) == step)).otherwise(False)
    each = fitting.where(F.size("windows") > 0).withColumns({"ats": F.transform("windows", lambda x: x["at"]), "plains": at_of("plain"), "literal": F.array_sort(F.array_distinct(at_of("same")))}).withColumns({"in_row": in_row, "same": F.forall("windows", lambda x: x["same"])})
    union = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("long")
    scored = each.groupBy("doc_id", "item_id").agg(union("ats").alias("n_windows"), union("plains").alias("n_plain"), F.bool_or("in_row").alias("in_row"), F.bool_and("same").alias("verbatim"))
    enough = (F.col("n_windows") >= F.col("item_windows") * coverage) | ((F.col("n_plain") > 0) & (F.col("n_plain") >= F.col("item_plain") * coverage)) | F.col("in_row")
    return scored.join(totals, "item_id").where(enough).select("doc_id", "item_id", "n_windows", "item_windows", "verbatim")
