"""Text to typed values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the sources write for on and off, and for labels.
ON_WORDS = ("1", "true", "on", "encendido", "si", "sí", "yes")
OFF_WORDS = ("0", "false", "off", "apagado", "no")
LABEL_WORDS = ("1", "true", "yes", "si", "sí")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")


def number(text: Column) -> Column:
    got = F.expr("try_cast(null as double)") if text is None else text.try_cast("double")
    return F.when(~F.isnan(got), got)


def coordinates(text: Column) -> tuple[Column, Column]:
    """``"lat, lon"``; further parts are ignored, both are null if one is not a number."""
    parts = F.split(text, ",")
    lat, lon = (number(F.trim(F.get(parts, F.lit(k)))) for k in (0, 1))
    ok = lat.isNotNull() & lon.isNotNull()
    return F.when(ok, lat), F.when(ok, lon)


def speed(text: Column) -> Column:
    """The first number in the text, whatever its unit."""
    return number(F.regexp_extract(text.cast("string"), r"([-+]?\d*\.?\d+)", 1))


def ignition(text: Column) -> Column:
    """On and off words, else a number above 0, else false."""
    word = F.lower(F.trim(text.cast("string")))
    return F.coalesce(F.when(word.isin(*ON_WORDS), True).when(word.isin(*OFF_WORDS), False).otherwise(number(word) > 0), F.lit(False))


def timestamp(text: Column) -> Column:
    """The first format that fits: ISO, then dotted, then day-first ones; UTC."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS])


def utc(text: Column) -> Column:
    """Zoned or plain ISO text; plain times are UTC already."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])


def label(c: Column, kind: str = "string") -> Column:
    if kind == "boolean":
        return F.coalesce(c.cast("int"), F.lit(0))
    if kind == "string":
        return F.coalesce(F.lower(F.trim(c)).isin(*LABEL_WORDS).cast("int"), F.lit(0))
    return F.coalesce((number(c.cast("string")) > 0).cast("int"), F.lit(0))


def tanks(left: Column, right: Column) -> Column:
    return F.coalesce(number(left), F.lit(0.0)) + F.coalesce(number(right), F.lit(0.0))


def vehicle_from_name(name: Column) -> Column:
    """First part of a file's name if it is alphanumeric, else all of it with spaces as underscores."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    first = F.get(F.split(base, r"[_\s\-.]"), F.lit(0))
    return F.when(first.rlike(r"^[\p{L}\p{N}]+$"), first).otherwise(F.replace(base, F.lit(" "), F.lit("_")))


def pick_column(columns: list[str], candidates: list[str], least: int = 3) -> str | None:
    """The column for the first candidate that fits: equal first, then contained; case does not count.

    Candidates shorter than ``least`` must be equal: a single letter is contained in almost anything.
    """
    low = {c.lower().strip(): c for c in reversed(columns)}
    for want in candidates:
        if want.lower() in low:
            return low[want.lower()]
    for want in candidates:
        if len(want) >= least:
            found = next((c for c in columns if want.lower() in c.lower()), None)
            if found:
                return found
    return None


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get ``__dup1``, ``__dup2`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen.get(c, 0)
        seen[c] = n + 1
        names.append(f"{c}__dup{n}" if n else c)
    return df.toDF(*names)


def column_kinds(df: DataFrame) -> DataFrame:
    """``column, kind``: numeric, binary (numbers that are all 0 or 1) or categorical; one pass."""
    numeric = [c for c, t in df.dtypes if re.match(r"(tiny|small|big)?int|double|float|decimal|boolean", t)]
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)), F.lit(False)).alias(c) for c in numeric]) if numeric else None
    kinds = [F.struct(F.lit(c).alias("column"), (F.when(F.col(c), "binary").otherwise("numeric") if c in numeric else F.lit("categorical")).alias("kind")) for c in df.columns]
    base = row if row is not None else df.sparkSession.range(1)
    return base.select(F.explode(F.array(*kinds)).alias("r")).select("r.*")


def time_profile(text: Column) -> list[Column]:
    """Aggregates over a time column of text: rows, readable ones, first and last."""
    t = timestamp(text)
    return [F.count("*").alias("n"), F.count(t).alias("n_valid"), F.count_if(t.isNull()).alias("n_null"), F.min(t).alias("first"), F.max(t).alias("last")]
