"""Structured Streaming jobs over the event table as a file stream, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VIEWS, with_views
from ..session import scratch_path
from ..streaming import feeds as ST
from ..streaming import state as SS
from . import feeds as Q
from .registry import ORACLES, query, r


def events(t):
    """The event table as a stream, with TIMESTAMP event time."""
    schema = t.spark.read.parquet(f"{t.dir}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.dir}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def view(t, name: str):
    df = events(t)
    df.createOrReplaceTempView("metroframe_event_stream")
    return t.spark.sql(VIEWS["fx_" + name][1].replace("{t}", "metroframe_event_stream"))


def _latest(key: str, ttl_ms: int, words: tuple[str, str, str], table: str = "events", off: str = "false") -> str:
    """A change for every row, and one where the next row of the key, or the end of the stream, is more than the time to live away."""
    appear, stay, leave = words
    return (
        f"s AS (SELECT {key}, epoch_us(ts)//1000 AS ms, {off} AS off FROM {table}), w AS (SELECT max(ms) AS wm FROM s), "
        f"o AS (SELECT {key}, ms, off, lag(ms) OVER k AS was, lag(off) OVER k AS was_off, lead(ms) OVER k AS nxt FROM s WINDOW k AS (PARTITION BY {key} ORDER BY ms, off)), "
        f"f AS (SELECT *, was IS NULL OR was_off OR ms - was > {ttl_ms} AS fresh FROM o) "
        f"SELECT {key}, ms AS event_ms, CASE WHEN off THEN '{leave}' WHEN fresh THEN '{appear}' ELSE '{stay}' END AS change FROM f WHERE NOT (off AND fresh) "
        f"UNION ALL SELECT {key}, ms + {ttl_ms}, '{leave}' FROM f, w WHERE NOT off AND (nxt - ms > {ttl_ms} OR (nxt IS NULL AND ms + {ttl_ms} < wm))"
    )


@query("WITH " + _latest("user_id", 20000, ("live", "live", "retired")))
def latest_by_key(t):
    """Events per user as live; users unseen for 20 s are retired, and may come back."""
    s = events(t).select("user_id", "ts", "value")
    return ST.run_available(SS.latest_by_key(s, "user_id", SS.retire_after(5.0))).select("user_id", "event_ms", "change")


@query(with_views("detections") + ", " + _latest("camera", 6000, ("live", "live", "stale"), "fx_detections"))
def detections_latest(t):
    s = view(t, "detections").select("camera", "ts", "frame", "det_id")
    return ST.run_available(SS.detections_latest(s)).select("camera", "event_ms", "change")


@query("WITH k AS (SELECT user_id % 40 AS camera, ts, event_type = 'error' AS off FROM events), " + _latest("camera", 12000, ("active", "active", "inactive"), "k", "off"))
def active_keys(t):
    """Viewer heartbeats with explicit off."""
    s = events(t).select((F.col("user_id") % 40).alias("camera"), "ts", (F.col("event_type") == "error").alias("off"))
    return ST.run_available(SS.active_keys(s)).select("camera", "event_ms", "change")


@query("WITH " + _latest("user_id", 5000, ("live", "live", "expired")))
def entity_ttl(t):
    s = events(t).select("user_id", "ts", "value")
    return ST.run_available(SS.entity_ttl(s, "user_id")).select("user_id", "event_ms", "change")


@query("WITH " + _latest("user_id", 60000, ("appear", "stay", "leave")))
def snapshot_stream_diff(t):
    s = events(t).select("user_id", "ts", "value")
    return ST.run_available(SS.snapshot_stream_diff(s, "user_id", 60.0)).select("user_id", "event_ms", "change")


@query()
def track_stream(t):
    """Live form of the tracker."""
    out = ST.run_available(SS.track_stream(view(t, "detections")))
    return out.select("camera", "frame", "track_id", r("x").alias("x"), r("z").alias("z"), r("heading").alias("heading"), "cls", "quad", "quads")


@query(with_views("detections") + " SELECT DISTINCT camera, frame FROM fx_detections")
def new_frames_only(t):
    return ST.run_available(ST.new_frames_only(view(t, "detections"))).select("camera", "frame")


@query("""WITH RECURSIVE w AS (SELECT user_id AS ix, event_id AS seq, list(value/20) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS l FROM events),
 q AS (SELECT ix, seq, list_sort(l)[len(l)//2+1] AS mid, row_number() OVER (PARTITION BY ix ORDER BY seq) AS n FROM w WHERE len(l) >= 4 AND list_max(l) - list_min(l) <= 1.0),
 c AS (SELECT ix, seq, mid, n, true AS told, mid AS held FROM q WHERE n = 1 UNION ALL SELECT q.ix, q.seq, q.mid, q.n, abs(q.mid - c.held) > 0.25, CASE WHEN abs(q.mid - c.held) > 0.25 THEN q.mid ELSE c.held END FROM c JOIN q ON q.ix = c.ix AND q.n = c.n + 1)
 SELECT ix, seq, round(mid,6)+0.0 AS value FROM c WHERE told""")
def settled_grid(t):
    """Commits of per-user sample series."""
    s = events(t).select(F.col("user_id").alias("ix"), F.col("event_id").alias("seq"), (F.col("value") / 20).alias("value"))
    return ST.run_available(SS.settled_grid(s, ["ix"])).withColumn("value", r("value"))


_SESS = """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM d)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, n"""


@query(_SESS)
def gap_sessions(t):
    """Activity spans with two-hour gaps (batch form)."""
    return ST.gap_sessions(t.events, "user_id", "2 hours")


@query(f"SELECT * FROM ({_SESS}) WHERE \"end\" <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def gap_sessions_stream(t):
    """Spans closed by the end of the stream."""
    return ST.run_available(ST.gap_sessions(events(t), "user_id", "2 hours"))


def _entities(t, sql: str, kind: str):
    from ..sources import schemas

    events(t).createOrReplaceTempView("metroframe_event_stream")
    rows = t.spark.sql(sql.replace("{t}", "metroframe_event_stream"))
    return rows.select("event_id", F.from_json("doc", schemas.FEED_ENTITY[kind]).alias("e"))


@query(ORACLES["vehicle_positions"])
def vehicle_stream(t):
    """Vehicle feed as a stream joined with static routes."""
    out = ST.run_available(ST.vehicle_positions(_entities(t, Q._VEHICLE, "vehicles"), Q.routes(t)))
    return out.select("event_id", "vehicle_id", "label", "route_id", "status", "occupancy", "lat", "route_short_name", "route_color")


@query(ORACLES["trip_updates"])
def arrivals_stream(t):
    out = ST.run_available(ST.arrivals_stream(_entities(t, Q._TRIP, "trips")))
    return out.select("event_id", "route_id", "trip_id", "stop_id", "arrival", "departure", "delay")


@query(ORACLES["alerts"])
def alerts_stream(t):
    out = ST.run_available(ST.alerts_stream(_entities(t, Q._ALERT, "alerts"), F.lit(20000)))
    return out.select("event_id", "header", "cause", "effect", "routes", "stops", "start")


@query("SELECT event_type, count(*) AS n, false AS stale FROM events GROUP BY event_type")
def last_good(t):
    """Counts kept by a foreachBatch sink, with the stale flag of the latest batch."""
    base = scratch_path(t.spark, "good-")
    sink = ST.last_good(lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), base)
    q = events(t).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return ST.read_last_good(t.spark, base).select("event_type", "n", "stale")
