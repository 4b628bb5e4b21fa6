"""Raw CSV in any header language to canonical telemetry, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwatch.functions import parse
from tankwatch.operators.quality import clean, require, validated
from tankwatch.operators.signal import preprocess
from tankwatch.params import Detection

#: Header names by canonical column; the first that fits wins.
HEADERS = {
    "vehicle_id": ["vehicle_id", "vehiculo", "veh_id", "vehicleid", "equipo"],
    "timestamp": ["tiempo", "timestamp", "time", "datetime", "fecha", "fechahora", "fecha_hora"],
    "coordinates": ["coordenadas", "coordinates", "coords", "coordinate"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "longitud"],
    "speed_kmh": ["velocidad", "speed", "speed_kmh", "velocidad km/h"],
    "ignition": ["ignición", "ignicion", "ignition", "ignition_status"],
    "total_fuel_gal": ["tanque total", "total_fuel", "fuel_level", "fuel", "totalfuel"],
    "left_tank": ["tanque izquierdo", "left_tank", "left_fuel"],
    "right_tank": ["tanque derecho", "right_tank", "right_fuel"],
    "label": ["stationary_drain", "drain", "fuel_drain", "label"],
}


def read_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    """All columns as text; a path that does not exist is an error."""
    return spark.read.option("recursiveFileLookup", recursive).csv(paths, header=True, encoding=encoding)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header, utf8``, a row for each file of the paths that is not empty: its first line and whether it is all UTF-8.

    One job over the lines of all files, in splits: a line end is never part of a longer character, so that a file is valid if all
    its lines are. No file is ever one value.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value"), F.monotonically_increasing_id().alias("_row"))
    return lines.groupBy("file").agg(F.min_by("value", F.when(F.col("_at") == 0, F.col("_row"))).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))


def place(path: str) -> str:
    """A path without its scheme where that is the local one, and without a slash at its end."""
    return re.sub("^file:/+", "/", path.rstrip("/"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there; a file or a folder."""
    conf = spark._jsc.hadoopConfiguration()
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if at(p).getFileSystem(conf).globStatus(at(p))]


def alike(spark: SparkSession, paths: list[str], by_header: bool = True) -> list[DataFrame]:
    """The files as text columns, one table for each kind of header and encoding, however many files there are."""
    keys = ["utf8", *(["header"] if by_header else [])]
    groups = manifest(spark, paths).groupBy(*keys).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()  # a row for each kind
    return [read_csv(spark, r.files, "UTF-8" if r.utf8 else "ISO-8859-1") for r in sorted(groups, key=lambda r: r.files[0])]


def read_any_encoding(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """UTF-8 files as such and the others as Latin-1; each file's bytes are tested where they lie."""
    parts = alike(spark, [paths] if isinstance(paths, str) else paths, by_header=False)
    if not parts:
        raise ValueError("no files")
    return union(parts)


def read_tolerant(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``file, line, n``: lines that do not fit the header, by file, with how often they come.

    Lines with too few or too many fields do not fit, which is also what an open quote leads to.
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.csv(paths, header=True, schema=full, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    # Spark parses a line only if one of its fields is asked for
    parsed = F.length(F.coalesce(*[F.col(f"`{f.name}`").cast("string") for f in schema.fields], F.lit(""))) >= 0
    bad = rows.select("*", F.col("_metadata.file_path").alias("file")).where(F.col("_bad").isNotNull() & parsed).groupBy("file", F.col("_bad").alias("line")).agg(F.count("*").alias("n"))
    return rows.where("_bad is null").drop("_bad"), bad


def standardise(df: DataFrame, vehicle_id: str | None = None, headers: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One projection to the canonical columns; a table without a time column is an error.

    A coordinate pair in one column goes before two columns, a total before the tanks, of which one may be missing.
    The vehicle is ``vehicle_id``, else the table's own column, else the file's name, else ``UNKNOWN``. Columns to
    ``keep`` stay as they are and are no candidates.
    """
    names, kept = {**HEADERS, **(headers or {})}, keep or []
    pick = {k: parse.pick_column([c for c in df.columns if c not in kept], v) for k, v in names.items()}
    if pick["timestamp"] is None:
        raise ValueError("no timestamp column")
    has = lambda k: pick[k] is not None
    none = F.lit(None).cast("double")
    col = lambda k: F.col(f"`{pick[k]}`").cast("string") if has(k) else F.lit(None).cast("string")
    vehicle = F.lit(vehicle_id) if vehicle_id else F.trim(col("vehicle_id")) if has("vehicle_id") else F.coalesce(F.nullif(parse.vehicle_from_name(F.input_file_name()), F.lit("")), F.lit("UNKNOWN"))
    if has("coordinates"):
        lat, lon = parse.coordinates(col("coordinates"))
    else:
        lat, lon = (parse.number(col("latitude")), parse.number(col("longitude"))) if has("latitude") and has("longitude") else (none, none)
    fuel = parse.number(col("total_fuel_gal")) if has("total_fuel_gal") else parse.tanks(col("left_tank"), col("right_tank")) if has("left_tank") or has("right_tank") else none
    out = {
        "timestamp": parse.timestamp(col("timestamp")), "vehicle_id": vehicle, "latitude": lat, "longitude": lon,
        "speed_kmh": parse.speed(col("speed_kmh")) if has("speed_kmh") else none,
        "ignition": parse.ignition(col("ignition")),
        "total_fuel_gal": fuel,
    }
    if has("label"):
        out["stationary_drain"] = parse.label(col("label"))
    return df.select(*[c.alias(k) for k, c in out.items()], *kept)


def load(spark: SparkSession, path: str, vehicle_id: str | None = None) -> DataFrame:
    return clean(require(standardise(read_csv(spark, path), vehicle_id)))


def load_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with the same header are read at once; a path that is not there, or whose header has no time, is skipped.

    If none is left it is an error.
    """
    found, parts = existing(spark, paths), []
    for path in sorted(set(paths) - set(found)):
        print(f"skipped {path}: not found")
    for raw in alike(spark, found) if found else []:
        try:
            parts.append(standardise(raw))
        except ValueError as e:
            print(f"skipped {', '.join(raw.columns)[:200]}: {e}")
    if not parts:
        raise ValueError("no source could be loaded")
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to combine")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def combine(parts: list[DataFrame], as_of, p: Detection = Detection()) -> DataFrame:
    """Union, one row for each vehicle and time, validation, conditioning."""
    return preprocess(validated(union(parts), as_of), p)


#: Folders of a table that is stored by a column. A folder for each value would be a file or more for each vehicle.
FOLDERS = 256


def save_table(df: DataFrame, path: str, by: str | None = "vehicle_id") -> None:
    """With ``by``, all rows of a value lie in one folder, by its hash, sorted by it, so that readers skip what lacks a value.

    Files follow the size of the table: a large folder is shared by several tasks, small ones by one.
    """
    if by:
        placed = df.withColumn("_folder", F.pmod(F.xxhash64(by), F.lit(FOLDERS)).cast("int"))
        placed.hint("rebalance", "_folder").sortWithinPartitions("_folder", by).write.mode("overwrite").partitionBy("_folder").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_folder")


def load_combined(spark: SparkSession, path: str) -> DataFrame:
    """The combined table with its time as a UTC timestamp, also where it was stored as text."""
    df = load_table(spark, path)
    return df.withColumn("timestamp", parse.utc(F.col("timestamp"))) if dict(df.dtypes)["timestamp"] == "string" else df


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV, with their times as UTC timestamps."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({c: parse.utc(F.col(c)) for c in ("start_time", "end_time")} | {c: parse.number(F.col(c)) for c in ("duration_min", "drop_gal", "min_step_gal") if c in df.columns})


#: Times in a report keep their microseconds.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def save_report(df: DataFrame, path: str) -> None:
    """A small nested report as JSON."""
    df.coalesce(1).write.mode("overwrite").option("timestampFormat", MICROSECONDS).json(path)
