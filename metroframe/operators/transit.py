"""Vehicle, arrival and alert rows from decoded feeds.

Each function takes a batch or a streaming table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lonlat_to_scene
from ..functions.predicates import arrival_in_horizon
from ..functions.scalars import decode_enum, eta_minutes, eta_seconds, translated_text
from ..plans.ordered import row_numbers

# Scene origin in UTM 16N: fixed values.
SCENE_A, SCENE_B = 719242.59, 4212857.25


def vehicle_rows(entities: DataFrame, a: float = SCENE_A, b: float = SCENE_B) -> DataFrame:
    """Vehicle entities (column ``e``) with scene position and decoded enums."""
    v = F.col("e.Vehicle")
    lat, lon = v["Position"]["Latitude"], v["Position"]["Longitude"]
    x, z = lonlat_to_scene(lon, lat, a, b)
    ident = F.coalesce(F.nullif(v["Vehicle"]["Id"], F.lit("")), F.col("e.Id"), F.lit(""))
    return entities.where(v.isNotNull() & lat.isNotNull() & lon.isNotNull()).select(
        *[c for c in entities.columns if c != "e"],
        ident.alias("vehicle_id"), v["Vehicle"]["Label"].alias("label"), v["Trip"]["RouteId"].alias("route_id"),
        v["Trip"]["TripId"].alias("trip_id"), v["StopId"].alias("stop_id"), v["CurrentStopSequence"].alias("seq"),
        decode_enum(v["CurrentStatus"], "vehicle_status").alias("status"),
        decode_enum(v["occupancy_status"], "occupancy").alias("occupancy"),
        F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), v["Position"]["Bearing"].alias("bearing"),
        v["Position"]["Speed"].alias("speed"), F.round(x, 2).alias("x"), F.round(z, 2).alias("z"), v["Timestamp"].alias("vts"),
    )


def trip_update_rows(entities: DataFrame) -> DataFrame:
    """One row per stop-time update."""
    t = F.col("e.TripUpdate")
    keep = [c for c in entities.columns if c != "e"]
    u = entities.where(t.isNotNull()).select(
        *keep, t["Trip"]["RouteId"].alias("route_id"), t["Trip"]["TripId"].alias("trip_id"), F.explode(t["StopTimeUpdates"]).alias("u")
    )
    return u.select(
        *keep, "route_id", "trip_id", F.col("u.StopId").alias("stop_id"), F.col("u.StopSequence").alias("seq"),
        F.col("u.Arrival.Time").alias("arrival"), F.col("u.Departure.Time").alias("departure"),
        F.coalesce("u.Arrival.Delay", "u.Departure.Delay").alias("delay"),
    )


def alert_rows(entities: DataFrame) -> DataFrame:
    """Alerts with text, decoded enums, scope and first active period."""
    al = F.col("e.Alert")
    period = F.get(al["ActivePeriods"], F.lit(0))
    return entities.where(al.isNotNull()).select(
        *[c for c in entities.columns if c != "e"],
        F.coalesce("e.Id", F.lit("")).alias("alert_id"),
        translated_text(al["HeaderText"]["Translations"]).alias("header"),
        translated_text(al["DescriptionText"]["Translations"]).alias("description"),
        decode_enum(al["cause"], "alert_cause").alias("cause"), decode_enum(al["effect"], "alert_effect").alias("effect"),
        alert_scope(al["InformedEntities"], "RouteId").alias("routes"), alert_scope(al["InformedEntities"], "StopId").alias("stops"),
        period["Start"].alias("start"), period["End"].alias("end"), al["Url"].alias("url"),
    )


def alert_scope(entities: Column, field: str) -> Column:
    """Sorted distinct non-NULL ids an alert informs."""
    ids = F.filter(F.transform(entities, lambda i: i[field]), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))


def _in_order(updates: DataFrame, key: str) -> DataFrame:
    """Updates with their 1-based place ``pos`` in their key's list: by arrival, NULL last.

    Rows with a place rather than one array per key, so a busy key is many tasks: the
    places are counted inside one-hour blocks.
    """
    known = updates.where(F.col(key).isNotNull()).withColumn("_late", F.coalesce("arrival", F.lit(2**62)))
    hour = F.floor(F.col("_late") / 3600)
    other = "trip_id" if key == "stop_id" else "stop_id"
    return row_numbers(known, [key], ["_late", other, "seq"], hour, "pos").drop("_late")


def arrivals_by_stop(updates: DataFrame) -> DataFrame:
    return _in_order(updates, "stop_id")


def arrivals_by_trip(updates: DataFrame) -> DataFrame:
    return _in_order(updates, "trip_id")


def arrival_rows(updates: DataFrame, now: Column, horizon: float = 3600) -> DataFrame:
    """Updates due within the horizon (or up to 2 minutes ago) with seconds and minutes to go."""
    due = updates.where(arrival_in_horizon(F.col("arrival"), now, horizon))
    return due.withColumn("eta_sec", eta_seconds(F.col("arrival"), now)).withColumn("eta_min", eta_minutes(F.col("arrival"), now))
