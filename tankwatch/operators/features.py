"""Features of events, and normalisation by vehicle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.geo import haversine
from tankwatch.functions.stats import large, median
from tankwatch.operators.intervals import event_points, keyed, lookback_points, trip, with_steps
from tankwatch.operators.quality import elapsed

NORMALISED = ["drop_gal", "duration_min", "n_negative_steps", "rate_gpm"]
NUMERIC = ["drop_gal", "duration_min", "min_step_gal", "n_points", "median_dt_s", "n_negative_steps", "mean_step_neg", "p95_abs_dfuel", "median_speed", "pct_ign_on", "duration_hours", "log_duration", "hour_sin", "hour_cos", "weekday", "time_since_last_event_hours", "lat_std", "lon_std", "coord_range_km", "window_trip_km", "pre_event_distance_km", "pre_event_avg_speed", "pre_event_moving_pct", "pre_event_fuel_change", "speed_std", "speed_max", "movement_variability", "rate_gpm"]
BINARY = ["is_weekend", "is_night", "is_first_event_of_day"]


#: A deviation up to this is what rounding leaves of equal values.
NO_SPREAD = 1e-9


def _statistics(noise: float) -> list[Column]:
    step = F.when(F.col("dfuel") < noise, F.col("dfuel"))
    return [
        F.count("*").alias("n_points"), median("dt_s").alias("median_dt_s"), F.count(step).cast("int").alias("_steps"), (-F.avg(step)).alias("mean_step_neg"),
        F.percentile(F.abs("dfuel"), F.lit(0.95)).alias("p95_abs_dfuel"), median("speed_kmh").alias("median_speed"), F.avg(F.col("ignition").cast("double")).alias("pct_ign_on"),
    ]


def _joined(events: DataFrame, own: DataFrame) -> DataFrame:
    return events.join(large(own), "event_key", "left")


def statistics(events: DataFrame, points: DataFrame, noise: float = -0.10) -> DataFrame:
    own = points.groupBy("event_key").agg(*_statistics(noise))
    return _with_statistics(_joined(events.drop("n_points", "median_dt_s"), own), events)


def _with_statistics(joined: DataFrame, events: DataFrame) -> DataFrame:
    out = joined.withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    if "n_negative_steps" not in events.columns:
        out = out.withColumn("n_negative_steps", F.coalesce("_steps", F.lit(0)))
    return out.drop("_steps")


def durations(events: DataFrame) -> DataFrame:
    out = events if "duration_min" in events.columns else events.withColumn("duration_min", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 6e7)
    return out.withColumns({"duration_hours": F.col("duration_min") / 60, "log_duration": F.log1p("duration_min")})


def clock(events: DataFrame) -> DataFrame:
    """From the middle of the event: the hour on a circle, weekday (Monday 0), weekend, night (22 to 5)."""
    out = events.withColumn("mid_time", F.timestamp_micros(((F.unix_micros("start_time") + F.unix_micros("end_time")) / 2).cast("long")))
    hour = F.hour("mid_time") + F.minute("mid_time") / 60
    turn = hour * (2 * math.pi / 24)
    return out.withColumns({"hour_of_day": hour, "hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "weekday": F.weekday("mid_time"), "is_weekend": (F.weekday("mid_time") >= 5).cast("int"), "is_night": ((F.hour("mid_time") >= 22) | (F.hour("mid_time") <= 5)).cast("int")})


def spacing(events: DataFrame) -> DataFrame:
    order = [F.col("start_time"), *[F.col(c) for c in ("end_time", "pattern") if c in events.columns]]
    w, day = W.partitionBy("vehicle_id").orderBy(*order), W.partitionBy("vehicle_id", F.to_date("start_time")).orderBy(*order)
    since = elapsed(F.lag("start_time").over(w), F.col("start_time")) / 3600
    return events.withColumns({"time_since_last_event_hours": F.coalesce(since, F.lit(-1.0)), "is_first_event_of_day": (F.row_number().over(day) == 1).cast("int")})


def temporal(events: DataFrame) -> DataFrame:
    return events.transform(durations).transform(clock).transform(spacing)


PLACES, SPEEDS = ["lat_std", "lon_std", "coord_range_km", "window_trip_km"], ["speed_std", "speed_max", "movement_variability"]


def _centred(points: DataFrame) -> DataFrame:
    """Points with their steps and the middle of their event's placed points."""
    w = W.partitionBy("event_key", "_placed")
    return with_steps(points).withColumns({f"_{c}_c": median(c).over(w) for c in ("latitude", "longitude")})


def _places() -> list[Column]:
    some = lambda c: F.when(F.col("_placed"), F.col(c))
    centre = [F.max(some(f"_{c}_c")).alias(f"{c[:3]}_c") for c in ("latitude", "longitude")]
    spread = [F.coalesce(F.stddev_samp(some(c)), F.lit(0.0)).alias(f"{c[:3]}_std") for c in ("latitude", "longitude")]
    reach = F.max(F.when(F.col("_placed"), haversine(F.col("_latitude_c"), F.col("_longitude_c"), F.col("latitude"), F.col("longitude"))))
    return [*centre, *spread, reach.alias("coord_range_km"), trip().alias("window_trip_km")]


def location(events: DataFrame, points: DataFrame) -> DataFrame:
    own = _centred(points).groupBy("event_key").agg(*_places())
    return _joined(events, own).fillna(0.0, PLACES)


def pre_event(events: DataFrame, telemetry: DataFrame, hours: float = 2, least: int = 5) -> DataFrame:
    """What the vehicle did before: zeros unless the look-back has enough rows."""
    points = with_steps(lookback_points(events, telemetry, hours, ["latitude", "longitude", "speed_kmh", "total_fuel_gal"]))
    fuel = F.col("total_fuel_gal").isNotNull()
    change = F.max_by("total_fuel_gal", F.when(fuel, F.col("timestamp"))) - F.min_by("total_fuel_gal", F.when(fuel, F.col("timestamp")))
    own = points.groupBy("event_key").agg(F.count("*").alias("_n"), F.coalesce(F.avg("speed_kmh"), F.lit(0.0)).alias("pre_event_avg_speed"), F.coalesce(F.avg(F.when(F.col("speed_kmh").isNotNull(), (F.col("speed_kmh") > 5).cast("double"))), F.lit(0.0)).alias("pre_event_moving_pct"), F.coalesce(F.when(F.count("total_fuel_gal") >= 2, change), F.lit(0.0)).alias("pre_event_fuel_change"), trip().alias("pre_event_distance_km"))
    return _joined(events, own.where(F.col("_n") >= least).drop("_n")).fillna(0.0, ["pre_event_avg_speed", "pre_event_moving_pct", "pre_event_fuel_change", "pre_event_distance_km"])


def _speeds() -> list[Column]:
    zero = F.lit(0.0)
    return [F.coalesce(F.stddev_samp("speed_kmh"), zero).alias("speed_std"), F.coalesce(F.max("speed_kmh"), zero).alias("speed_max"), F.coalesce(F.var_samp("speed_kmh"), zero).alias("movement_variability")]


def variability(events: DataFrame, points: DataFrame) -> DataFrame:
    return _joined(events, points.groupBy("event_key").agg(*_speeds())).fillna(0.0, SPEEDS)


def with_rate(events: DataFrame) -> DataFrame:
    return events if "rate_gpm" in events.columns else events.withColumn("rate_gpm", F.col("drop_gal") / (F.col("duration_min") + 1e-6))


def fit_norms(events: DataFrame, columns: list[str] = NORMALISED) -> DataFrame:
    """Mean and deviation by vehicle on training rows; a deviation of zero or none becomes tiny."""
    rows = events.where("is_train") if "is_train" in events.columns else events
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return rows.groupBy("vehicle_id").agg(*aggs).withColumns({f"{c}_std": F.when(F.col(f"{c}_std") > NO_SPREAD, F.col(f"{c}_std")).otherwise(1e-6) for c in columns})


def zscores(events: DataFrame, norms: DataFrame, columns: list[str] = NORMALISED) -> DataFrame:
    """A vehicle without norms gets 0."""
    out = events.join(large(norms), "vehicle_id", "left")
    return out.withColumns({f"{c}_vehicle_zscore": F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0)) for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std")])


def vehicle_fuel(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("vehicle_id").agg(F.avg("total_fuel_gal").alias("avg_fuel"), F.max("total_fuel_gal").alias("max_fuel"))


def relative_drop(events: DataFrame, telemetry: DataFrame) -> DataFrame:
    out = events.join(large(vehicle_fuel(telemetry)), "vehicle_id", "left")
    return out.withColumns({"drop_vs_avg": F.coalesce(F.col("drop_gal") / (F.col("avg_fuel") + 1e-6), F.lit(0.0)), "drop_vs_capacity": F.coalesce(F.col("drop_gal") / (F.col("max_fuel") + 1e-6), F.lit(0.0))}).drop("avg_fuel", "max_fuel")


def labels(events: DataFrame, telemetry: DataFrame, label: str = "stationary_drain") -> DataFrame:
    """``y``: whether any row in the window is labelled; null if telemetry has no labels."""
    if label not in telemetry.columns:
        return events.withColumn("y", F.lit(None).cast("int"))
    own = event_points(events, telemetry, [label]).groupBy("event_key").agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    return _joined(events, own).withColumn("y", F.coalesce("y", F.lit(0)))


@dataclass
class FeatureBuilder:
    """Fitted by vehicle on training events; the window join is made once for all window features."""

    hours: float = 2
    spatial: bool = True
    behavioral: bool = True
    norms: DataFrame | None = None

    def base(self, events: DataFrame, telemetry: DataFrame) -> DataFrame:
        own = events if "event_key" in events.columns else keyed(events)
        points = event_points(own, telemetry, ["dt_s", "dfuel", "speed_kmh", "ignition", "latitude", "longitude"]).repartition("event_key")
        points = _centred(points) if self.spatial else points
        window = points.groupBy("event_key").agg(*_statistics(-0.10), *(_places() if self.spatial else []), *(_speeds() if self.behavioral else []))
        out = temporal(_with_statistics(_joined(own.drop("n_points", "median_dt_s"), window), own))
        out = out.fillna(0.0, (PLACES if self.spatial else []) + (SPEEDS if self.behavioral else []))
        return with_rate(pre_event(out, telemetry, self.hours) if self.behavioral else out)

    def fit(self, events: DataFrame, telemetry: DataFrame) -> FeatureBuilder:
        self.norms = fit_norms(self.base(events, telemetry))
        return self

    def transform(self, events: DataFrame, telemetry: DataFrame) -> DataFrame:
        if self.norms is None:
            raise RuntimeError("the feature builder is not fitted")
        return relative_drop(zscores(self.base(events, telemetry), self.norms), telemetry)


def matrix(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The model's columns that are present, the label with null as 0, and others to ``keep``."""
    have = [c for c in [*NUMERIC, *BINARY, "pattern"] if c in events.columns]
    y = F.coalesce(F.col("y"), F.lit(0)) if "y" in events.columns else F.lit(0)
    return events.select("event_key", *have, y.cast("int").alias("y"), *[c for c in keep or [] if c not in have])
