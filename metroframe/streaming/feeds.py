"""Feed streams: stateless decoding, deduplication, sessions, windows and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import flow_class
from ..operators.aggregates import principal_axis, split_two_way
from ..operators.lookups import route_enrich
from ..operators.tracks import associate_image_tracks, moving_tracks
from ..operators.transit import alert_rows, trip_update_rows, vehicle_rows
from ..session import scratch_path
from .state import closed_windows


def vehicle_positions(entities: DataFrame, routes: DataFrame) -> DataFrame:
    """Decoded vehicles joined with the static route table."""
    return route_enrich(vehicle_rows(entities), routes)


def arrivals_stream(entities: DataFrame) -> DataFrame:
    """Stop-time updates; keep the newest batch per trip with ``newest_per_trip``."""
    return trip_update_rows(entities)


def newest_per_trip(updates: DataFrame) -> DataFrame:
    """Updates of each trip's latest feed."""
    last = updates.groupBy("trip_id").agg(F.max("feed_ts").alias("_last"))
    return updates.join(last, "trip_id").where(F.col("feed_ts") == F.col("_last")).drop("_last")


def alerts_stream(entities: DataFrame, now: Column | None = None) -> DataFrame:
    """Decoded alerts; with ``now`` (unix seconds) only those in their active period."""
    alerts = alert_rows(entities)
    if now is None:
        return alerts
    return alerts.where((F.coalesce("start", F.lit(0)) <= now) & (F.coalesce("end", F.lit(2**62)) >= now))


def new_frames_only(stream: DataFrame, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Each (camera, frame) once."""
    marked = stream.withWatermark(ts, late)
    if stream.isStreaming:
        return marked.dropDuplicatesWithinWatermark(["camera", "frame"])
    return stream.dropDuplicates(["camera", "frame"])


def gap_sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Activity spans per key: start, end (last event plus gap) and events."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    g = marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def flow_window(dets: DataFrame, seconds: int = 12, ts: str = "ts") -> DataFrame:
    """Flow directions per camera, quad and tumbling window of detections (det_id, frame, cls, u, v).

    Runs on a batch; as a stream, ``flow_window_stream`` hands closed windows to ``flow_window_sink``.
    """
    w = F.window(ts, f"{seconds} seconds")
    rows = dets.where(flow_class(F.col("cls"))).withColumn("_w", F.unix_seconds(w["start"]))
    rows = rows.withColumn("camera_", F.struct("camera", "_w"))
    keyed = rows.select(F.to_json("camera_").alias("camera"), "quad", "frame", "det_id", "cls", "u", "v")
    flows = moving_tracks(associate_image_tracks(keyed))
    axis = principal_axis(flows, ["camera", "quad"])
    sides = split_two_way(flows, axis, ["camera", "quad"]).join(axis.select("camera", "quad", "coherence", "n"), ["camera", "quad"])
    types = dict(dets.dtypes)
    key = F.from_json("camera", f"camera {types['camera']}, _w bigint")
    return sides.select(
        key["camera"].alias("camera"), key["_w"].alias("window_start"), "quad", "side", "dir_x", "dir_z", "count", "speed", "coherence", "n"
    )


def flow_window_sink(path: str, seconds: int = 12) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: flows of each micro-batch to ``path/batch=<id>``; a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        flow_window(batch, seconds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def flow_window_stream(dets: DataFrame, path: str, seconds: int = 12, ts: str = "ts", late: str = "0 seconds"):
    """Started query that writes the flows of each window of a detection stream once it is over.

    Rows wait in state until the watermark passes their window, so no window is cut at a micro-batch's border.
    """
    rows = closed_windows(dets.select("camera", "quad", "frame", "det_id", "cls", "u", "v", ts), seconds, ts, "camera", late)
    sink = flow_window_sink(f"{path}/flows", seconds)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch.withColumn(ts, F.timestamp_millis(F.col(f"{ts}_ms"))), batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")


# ---- last good payload ---------------------------------------------------------
def last_good(build: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the last good table.

    ``build`` turns a micro-batch into rows.  If it fails or gives none, the table of
    the previous good batch stays and the status row is marked stale.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        error = None
        try:
            build(batch).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
            good = not batch.sparkSession.read.parquet(f"{path}/data/batch={batch_id}").isEmpty()
        except Exception as e:  # noqa: BLE001 - a bad payload must not stop the feed
            good, error = False, str(e).splitlines()[0]
        status = [(batch_id, good, error)]
        batch.sparkSession.createDataFrame(status, "batch bigint, good boolean, error string").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/status/{batch_id}")

    return write


def read_last_good(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last good batch with ``stale`` and ``error`` of the latest one."""
    status = spark.read.schema("batch bigint, good boolean, error string").json(f"{path}/status/*")
    now = status.agg(
        F.max(F.when(F.col("good"), F.col("batch"))).alias("b"), F.max_by("good", "batch").alias("g"), F.max_by("error", "batch").alias("e")
    ).first()
    if now.b is None:
        raise ValueError("no good batch yet")
    data = spark.read.parquet(f"{path}/data/batch={now.b}")
    return data.withColumn("stale", F.lit(not now.g)).withColumn("error", F.lit(now.e).cast("string"))


# ---- driving a stream to its end -------------------------------------------------
def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return the sink's rows.

    The sink and its checkpoint live in the shared folder, so a lost executor or a
    restarted driver goes on from the last committed batch.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream-")
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
