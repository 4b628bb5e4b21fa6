"""Document fingerprints by spot signatures, with DataFrame functions only.

A spot is a common word with the chain of content words that follow it; the set of a text's spots is its fingerprint. Boilerplate
such as menus has few common words, so that spots stand for the running text. Sets are compared by Jaccard similarity: two
sets can only be alike if their sizes are, so they are partitioned by size, and within a partition they meet on their rarest spots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.llm.common import discard, resolved, written

#: Content words of a chain, and words for each of which a text must have one common one; else each of its words begins a spot.
CHAIN, SPARSE = 2, 20
#: Common words of four languages, which spots begin with; the mark that parts the entries of lists and menus is one as well.
ANCHORS = (
    "| a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their them there they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der die ein eine einen einer er es für hat im ist mit nach nicht oder sich sie sind und von war wie wird zu zum zur "
    "al como con del el ella esta fue ha las lo los más no o para pero por si sin su sus todo una uno y"
).split()


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, and marks between entries."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[|•·»]+", " | "), r"[^\p{L}\p{N}|]+"), lambda w: w != "")


def _spots(all_words: Column, content: Column, text: Column, anchors: list[str], chain: int) -> Column:
    places = F.array_compact(F.transform(all_words, lambda w, i: F.when(w.isin(anchors), i)))
    # before the j-th anchor at place i stand j anchors and i - j content words
    found = F.transform(places, lambda i, j: F.when(i - j + chain <= F.size(content), F.xxhash64(F.get(all_words, i), F.slice(content, i - j + 1, chain))))
    each = F.transform(all_words, lambda w, i: F.when(i + chain < F.size(all_words), F.xxhash64(w, F.slice(all_words, i + 2, chain))))
    whole = F.array(F.when(F.size(all_words) > 0, F.xxhash64(all_words)).otherwise(F.xxhash64(text)))
    some = F.array_compact(F.when((F.size(all_words) - F.size(content)) * SPARSE >= F.size(all_words), found).otherwise(each))
    return F.array_distinct(F.transform(F.when(F.size(some) > 0, some).otherwise(whole), lambda h: F.shiftright(h, 32).cast("int")))


def with_spots(df: DataFrame, text: Column, name: str = "spots", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """Adds the spots of ``text`` as an array of different 32-bit numbers, never empty.

    In a text with too few common words, every word begins a spot. A text without any spot is one as a whole: all its words, or all
    of it if it has none. A null text is an empty one.
    """
    anchors = sorted(set(ANCHORS if anchors is None else anchors))
    words_of, rest = f"_{name}_words", f"_{name}_content"
    plain = F.coalesce(text, F.lit(""))
    split = df.withColumn(words_of, words(plain)).withColumn(rest, F.filter(words_of, lambda w: ~w.isin(anchors)))
    return split.withColumn(name, _spots(F.col(words_of), F.col(rest), plain, anchors, chain)).drop(words_of, rest)


def fingerprint(spots: Column) -> Column:
    """A set of spots as text: eight hexadecimal digits for each, in order. Equal texts have equal fingerprints."""
    return F.array_join(F.sort_array(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of spots."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def successors(keys: DataFrame) -> DataFrame:
    """Adds ``next_doc, next_print``, the key that follows; the first one follows the last. ``keys(doc, print, ...)`` are distinct.

    Keys are dealt in ranges, so that each task orders its own; what follows a range is the first key of the next one, of
    which there are as many as ranges.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(keys.repartitionByRange(parts, "doc", "print").withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct("doc", "print")
    inside = placed.withColumn("_next", F.lead(key).over(W.partitionBy("_range").orderBy("doc", "print")))
    firsts = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    row = W.orderBy("_range")  # a row for each range
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(row), F.first("_first").over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_after"))
    both = inside.join(F.broadcast(after), "_range")
    out = written(both.select(*keys.columns, F.coalesce("_next", "_after").alias("_n")).select(*keys.columns, F.col("_n.doc").alias("next_doc"), F.col("_n.print").alias("next_print")), "successors")
    discard(placed)
    return out


def compare_edits(docs: DataFrame, part: int = 4, anchors: list[str] | None = None, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited``.

    The edited text has in place of its last ``floor(n_chars / part)`` characters (code points) as many first ones of the next
    document, or all of them, by rising id; the last document is followed by the first. ``near_edited`` and ``near_next`` are the Jaccard
    similarities of a text's spots with those of the edited text and of the next document.

    A null text is empty. Null ids come first; rows that share an id are ordered by their texts' hashes, and equal rows count as
    one document in this order, so that none follows itself unless it is the only one; each row has its result. An empty table gives
    an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row for each id (that is never null) and text, however often it comes: both joins read these, dealt once
    number = F.coalesce("doc_id", F.lit(-(1 << 63)))
    named = rows.select(number.alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("print"), "doc_id", "text")
    each = with_spots(named, F.col("text"), "spots", anchors, chain)
    base = each.groupBy("doc", "print").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "spots")], F.count("*").cast("int").alias("copies"))
    lengths = named.select("doc", "print", F.floor(F.char_length("text") / part).cast("int").alias("want")).groupBy("doc", "print").agg(F.max("want").alias("want"))
    after = successors(lengths).select(F.col("next_doc").alias("doc"), F.col("next_print").alias("print"), F.col("doc").alias("own_doc"), F.col("print").alias("own_print"), "want")
    # the condition always holds: with it this join reads the columns that the other one does, and Spark deals the texts once for both
    heads = base.where("copies > 0 and (doc_id is null or doc_id = doc)").join(after, ["doc", "print"]).select(F.col("own_doc").alias("doc"), F.col("own_print").alias("print"), "want", F.expr("substring(text, 1, want)").alias("head"), F.col("spots").alias("next_spots"))
    joined = base.join(heads, ["doc", "print"])
    edited = joined.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - want as int)), head)"))
    both = with_spots(edited, F.col("edited"), "edited_spots", anchors, chain)
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"), "edited",
    )


def near_duplicates(docs: DataFrame, percent: int = 80, anchors: list[str] | None = None, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of spots have a Jaccard similarity of ``percent`` or more: ``doc_id, n_spots, component_id``.

    ``component_id`` is the smallest id reachable by links, itself included. Sets of equal size class or of neighbouring
    ones meet, if they share a spot of their prefixes: of the rarest spots of each, as many as two similar sets can't both lack. Equal
    sets are one node from the start, so copies make no pairs. Rows with a null id are left out; repeated rows have one result;
    null texts are empty, and empty ones are alike.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = with_spots(rows, F.col("text"), "spots", anchors, chain).select("doc_id", F.sort_array("spots").alias("spots"))
    of_docs = written(signed.select("doc_id", F.xxhash64("spots").alias("node"), "spots"), "spots")
    sets = written(of_docs.groupBy("node").agg(F.first("spots").alias("spots")).withColumn("size", F.size("spots")), "spot-sets")
    each = sets.select("node", "size", F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count("*").alias("count"))
    ranked = each.join(counts, "spot").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("count", "spot"))).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1)
    # sizes of one class differ by less than the factor of similar sets, so that such sets are of one class or of neighbours
    class_ = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    met = ranked.select("node", "size", F.explode(prefix).alias("s"), class_.alias("class")).select("node", "size", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("s.spot").alias("spot"))
    keyed = met.select(F.xxhash64("class", "spot").alias("bucket"), "node", "size").distinct()
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket")
    members = written(keyed.join(shared, "bucket"), "spot-buckets")

    def verify(pairs: DataFrame) -> DataFrame:
        spots = lambda x: sets.select(F.col("node").alias(x), F.col("spots").alias(f"{x}_spots"))
        same = F.size(F.array_intersect("a_spots", "b_spots"))
        full = F.size("a_spots") + F.size("b_spots") - same
        return pairs.join(spots("a"), "a").join(spots("b"), "b").where(same * 100 >= full * percent).select("a", "b")

    near = lambda x, y: F.least(f"{x}.size", f"{y}.size") * 100 >= F.greatest(f"{x}.size", f"{y}.size") * percent
    groups = resolved(members, verify, near)
    placed = of_docs.select("doc_id", "node", F.size("spots").cast("long").alias("n_spots")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = written(placed.join(least, "component").select("doc_id", "n_spots", "component_id").distinct(), "spot-groups")
    discard(of_docs, sets, members, groups)
    return out
