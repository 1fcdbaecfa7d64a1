"""Feeds, documents and schedules derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lookups as L
from ..operators import transit as T
from ..sources import files as S
from ..sources import schemas
from ..streaming import feeds as ST
from .registry import query, r

# Each event becomes one feed entity, built as JSON text and parsed with the feed's schema.
_VEHICLE = """SELECT event_id, concat('{"Id":"', CAST(event_id AS VARCHAR(20)), '","Vehicle":{"Trip":{"TripId":"T', CAST(event_id % 40 AS VARCHAR(20)), '","RouteId":"', CAST(event_id % 25 AS VARCHAR(20)), '"},"Vehicle":{"Id":"',
 CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR(20)) END, '","Label":"Bus ', CAST(user_id AS VARCHAR(20)), '"},"Position":{"Latitude":',
 CASE WHEN event_id % 13 = 0 THEN 'null' ELSE concat('38.0', CAST(1000 + event_id % 8999 AS VARCHAR(20))) END, ',"Longitude":-84.5', CAST(1000 + (event_id*7) % 8999 AS VARCHAR(20)),
 ',"Bearing":90,"Speed":4.5},"CurrentStopSequence":3,"StopId":"S', CAST(event_id % 60 AS VARCHAR(20)), '","CurrentStatus":', CAST(event_id % 4 AS VARCHAR(20)), ',"Timestamp":1781698662,"occupancy_status":', CAST(event_id % 9 AS VARCHAR(20)), '}}') AS doc FROM {t}"""
_TRIP = """SELECT event_id, concat('{"Id":"', CAST(event_id AS VARCHAR(20)), '","TripUpdate":{"Trip":{"RouteId":"', CAST(user_id % 25 AS VARCHAR(20)), '","TripId":"T', CAST(user_id AS VARCHAR(20)), '"},"StopTimeUpdates":[{"StopId":"S', CAST(event_id % 60 AS VARCHAR(20)),
 '","StopSequence":1,"Arrival":{"Time":', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(1700000000 + event_id*3 AS VARCHAR(20)) END, ',"Delay":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '30' END, '},"Departure":{"Time":', CAST(1700000060 + event_id*3 AS VARCHAR(20)), ',"Delay":45}}]}}') AS doc FROM {t}"""
_ALERT = """SELECT event_id, concat('{"Id":"', CAST(event_id AS VARCHAR(20)), '","Alert":{"ActivePeriods":[{"Start":', CAST(event_id*10 AS VARCHAR(20)), ',"End":', CAST(event_id*10+500 AS VARCHAR(20)), '}],"InformedEntities":[{"RouteId":"', CAST(event_id % 9 AS VARCHAR(20)), '"},{"RouteId":"', CAST(event_id % 4 AS VARCHAR(20)),
 '","StopId":"S', CAST(event_id % 60 AS VARCHAR(20)), '"}],"cause":', CAST(event_id % 14 AS VARCHAR(20)), ',"effect":', CAST(event_id % 13 AS VARCHAR(20)), ',"HeaderText":{"Translations":[{"Text":"', event_type, '","Language":"', CASE WHEN event_id % 2 = 0 THEN 'fr' ELSE 'en' END, '"},{"Text":"closed","Language":"en"}]}}}') AS doc FROM {t}"""


def entities(t, sql: str, kind: str, source: str = "events"):
    getattr(t, source).createOrReplaceTempView(f"metroframe_{source}")
    rows = t.spark.sql(sql.replace("{t}", f"metroframe_{source}"))
    return rows.select("event_id", F.from_json("doc", schemas.FEED_ENTITY[kind]).alias("e"))


def routes(t):
    return t.nation.select(
        F.col("n_nationkey").cast("string").alias("route_id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("short_name"),
        F.when(F.col("n_nationkey") % 3 == 0, None).otherwise("ff0000").alias("color"), F.col("n_name").alias("long_name"),
        (F.col("n_nationkey") * 7 % 25).cast("int").alias("sort_order"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS vehicle_id, concat('Bus ', user_id) AS label, CAST(event_id % 25 AS VARCHAR) AS route_id,
 CASE event_id % 4 WHEN 0 THEN 'incoming_at' WHEN 1 THEN 'stopped_at' WHEN 2 THEN 'in_transit_to' END AS status, CASE event_id % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'many_seats' WHEN 2 THEN 'few_seats' WHEN 3 THEN 'standing_room' WHEN 4 THEN 'crushed_standing' WHEN 5 THEN 'full' WHEN 6 THEN 'not_accepting' END AS occupancy,
 CAST(concat('38.0', 1000 + event_id % 8999) AS DOUBLE) AS lat, CASE WHEN n.n_nationkey % 4 = 0 THEN CAST(n.n_nationkey AS VARCHAR) ELSE n.n_name END AS route_short_name, CASE WHEN n.n_nationkey % 3 = 0 THEN '3b82c4' ELSE 'ff0000' END AS route_color
 FROM events LEFT JOIN nation n ON n.n_nationkey = event_id % 25 WHERE event_id % 13 <> 0""")
def vehicle_positions(t):
    """Decoded vehicles with their route."""
    out = ST.vehicle_positions(entities(t, _VEHICLE, "vehicles"), routes(t))
    return out.select("event_id", "vehicle_id", "label", "route_id", "status", "occupancy", "lat", "route_short_name", "route_color")


@query("SELECT c_custkey, n_name AS route_long_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3")
def route_enrich(t):
    v = t.customer.select("c_custkey", (F.col("c_nationkey") + 3).cast("string").alias("route_id"))
    return L.route_enrich(v, routes(t)).select("c_custkey", "route_long_name")


_UPD = """u AS (SELECT event_id, CAST(user_id % 25 AS VARCHAR) AS route_id, concat('T', user_id) AS trip_id, concat('S', event_id % 60) AS stop_id, CASE WHEN event_id % 5 <> 0 THEN 1700000000 + event_id*3 END AS arrival, 1700000060 + event_id*3 AS departure, CASE WHEN event_id % 3 = 0 THEN 45 ELSE 30 END AS delay FROM events)"""


@query(f"WITH {_UPD} SELECT event_id, route_id, trip_id, stop_id, arrival, departure, delay FROM u")
def trip_updates(t):
    return T.trip_update_rows(entities(t, _TRIP, "trips")).select("event_id", "route_id", "trip_id", "stop_id", "arrival", "departure", "delay")


def _updates(t):
    return T.trip_update_rows(entities(t, _TRIP, "trips"))


def _placed(key: str, other: str) -> str:
    return f"WITH {_UPD} SELECT {key}, arrival, row_number() OVER (PARTITION BY {key} ORDER BY arrival NULLS LAST, {other}) AS pos FROM u"


@query(_placed("stop_id", "trip_id"))
def arrivals_by_stop(t):
    """Arrivals of each stop in order, unknown times last."""
    return T.arrivals_by_stop(_updates(t)).select("stop_id", "arrival", "pos")


@query(_placed("trip_id", "stop_id"))
def arrivals_by_trip(t):
    return T.arrivals_by_trip(_updates(t)).select("trip_id", "arrival", "pos")


@query(f"WITH {_UPD} SELECT event_id, stop_id, arrival - 1700005000 AS eta_sec, CAST(floor((arrival - 1700005000)/60.0E0 + 0.5) AS BIGINT) AS eta_min FROM u WHERE arrival - 1700005000 > -120 AND arrival - 1700005000 < 3600")
def arrival_rows(t):
    out = T.arrival_rows(_updates(t), F.lit(1700005000))
    return out.select("event_id", "stop_id", "eta_sec", "eta_min")


@query("SELECT trip_id, count(*) AS updates, max(feed_ts) AS feed_ts FROM (SELECT concat('T', user_id) AS trip_id, event_id // 1000 AS feed_ts, max(event_id // 1000) OVER (PARTITION BY user_id) AS last FROM events) WHERE feed_ts = last GROUP BY trip_id")
def newest_per_trip(t):
    """Stop-time updates of each trip's latest feed."""
    u = _updates(t).withColumn("feed_ts", F.floor(F.col("event_id") / 1000))
    return ST.newest_per_trip(u).groupBy("trip_id").agg(F.count(F.lit(1)).alias("updates"), F.max("feed_ts").alias("feed_ts"))


_CAUSES = ["unknown", "other", "technical_problem", "strike", "demonstration", "accident", "holiday", "weather", "maintenance", "construction", "police_activity", "medical_emergency"]
_EFFECTS = ["no_service", "reduced_service", "significant_delays", "detour", "additional_service", "modified_service", "other", "unknown", "stop_moved", "no_effect", "accessibility_issue"]


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'closed' ELSE event_type END AS header, CASE WHEN event_id % 14 BETWEEN 1 AND 12 THEN {_CAUSES!r}[CAST(event_id % 14 AS INTEGER)] END AS cause, CASE WHEN event_id % 13 BETWEEN 1 AND 11 THEN {_EFFECTS!r}[CAST(event_id % 13 AS INTEGER)] END AS effect,
 list_sort(list_distinct([CAST(event_id % 9 AS VARCHAR), CAST(event_id % 4 AS VARCHAR)])) AS routes, [concat('S', event_id % 60)] AS stops, event_id*10 AS start FROM events WHERE event_id*10 <= 20000 AND event_id*10+500 >= 20000""")
def alerts(t):
    """Alerts active at a moment, with text, cause, effect and scope."""
    out = ST.alerts_stream(entities(t, _ALERT, "alerts"), F.lit(20000))
    return out.select("event_id", "header", "cause", "effect", "routes", "stops", "start")


@query("SELECT event_id, list_sort(list_distinct([CAST(event_id % 9 AS VARCHAR), CAST(event_id % 4 AS VARCHAR)])) AS routes FROM events")
def alert_scope(t):
    return T.alert_rows(entities(t, _ALERT, "alerts")).select("event_id", "routes")


# ---- schedules -----------------------------------------------------------------------
@query("""WITH s AS (SELECT DISTINCT l_suppkey AS stop, CAST(o_custkey % 25 AS VARCHAR) AS route FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT stop AS stop_id, list(route ORDER BY CAST(route AS BIGINT)*7 % 25, route) AS routes FROM s GROUP BY stop""")
def stop_routes(t):
    """Routes calling at each stop (supplier) by way of its trips (orders)."""
    times = t.lineitem.select(F.col("l_suppkey").alias("stop_id"), F.col("l_orderkey").alias("trip_id"))
    trips = t.orders.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 25).cast("string").alias("route_id"))
    return L.stop_routes(times, trips, routes(t))


@query("""WITH u AS (SELECT DISTINCT o_custkey % 25 AS route_id, o_custkey AS shape_id FROM orders ) SELECT route_id, shape_id, o_orderkey AS seq FROM u JOIN orders ON o_custkey = shape_id""")
def route_shapes(t):
    o = t.orders
    trips = o.select((F.col("o_custkey") % 25).alias("route_id"), F.col("o_custkey").alias("shape_id"))
    shapes = o.select(F.col("o_custkey").alias("shape_id"), F.col("o_orderkey").alias("seq"))
    return L.route_shapes(trips, shapes).select("route_id", "shape_id", "seq")


# ---- map elements ----------------------------------------------------------------------
def osm(t):
    """Suppliers as nodes, orders as ways (refs to suppliers, some missing), customers as relations."""
    k, span = F.col("o_orderkey"), F.lit(t.supplier.count() * 13 // 10 + 1)
    refs = F.array(*[((k * m + a) % span).cast("long") for m, a in ((7, 1), (11, 5), (13, 9), (17, 2))])
    ways = t.orders.select(k.alias("way_id"), refs.alias("nodes"))
    nodes = t.targets.select(F.col("target_id").alias("id"), "x", "z")
    c = F.col("c_custkey")
    role = F.when(c % 4 == 0, "outer").when(c % 4 == 1, "inner").when(c % 4 == 2, "").otherwise("label")
    member = F.array(F.struct(F.lit("way").alias("type"), (c * 5).alias("ref"), role.alias("role")))
    return ways, nodes, t.customer.select(c.alias("rel_id"), member.alias("members"))


_REFS = "refs AS (SELECT o_orderkey AS way_id, unnest([{'p':0,'n':(o_orderkey*7+1)%m},{'p':1,'n':(o_orderkey*11+5)%m},{'p':2,'n':(o_orderkey*13+9)%m},{'p':3,'n':(o_orderkey*17+2)%m}]) AS r FROM orders, (SELECT count(*)*13//10 + 1 AS m FROM supplier)), nd AS (SELECT s_suppkey AS id, CAST((s_suppkey*6151) % 10007 AS DOUBLE)/10 AS x FROM supplier)"


@query(f"WITH {_REFS} SELECT way_id, list(x ORDER BY r.p) AS xs FROM refs JOIN nd ON nd.id = r.n GROUP BY way_id")
def resolve_node_refs(t):
    """Way coordinates, unknown nodes dropped."""
    ways, nodes, _ = osm(t)
    return L.resolve_node_refs(ways, nodes).select("way_id", F.col("pts.x").alias("xs"))


@query(f"WITH {_REFS} SELECT way_id, list(x ORDER BY r.p) AS xs FROM refs LEFT JOIN nd ON nd.id = r.n GROUP BY way_id HAVING count(*) = count(x)")
def resolve_node_refs_strict(t):
    ways, nodes, _ = osm(t)
    return L.resolve_node_refs(ways, nodes, "reject").select("way_id", F.col("pts.x").alias("xs"))


@query("SELECT o_orderkey AS way_id FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey*5 FROM customer WHERE c_custkey % 4 <> 3)")
def standalone_ways(t):
    ways, _, rel = osm(t)
    return L.standalone_ways(ways, rel).select("way_id")


@query(f"WITH {_REFS} SELECT r.n AS node_id, count(*) AS ways FROM refs GROUP BY r.n HAVING count(*) >= 2")
def node_usage(t):
    return A.node_usage(osm(t)[0])


@query("SELECT type, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type FROM events) GROUP BY type")
def read_osm(t):
    """Map elements parsed from JSON and split by kind."""
    kind = F.when(F.col("event_id") % 3 == 0, "node").when(F.col("event_id") % 3 == 1, "way").otherwise("relation")
    doc = t.events.select(F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.col("event_id").alias("id"))).alias("elements"))).alias("j"))
    parsed = doc.select(F.explode(F.from_json("j", schemas.OSM)["elements"]).alias("e"))
    parts = zip(("node", "way", "relation"), S.split_osm(parsed))
    out = None
    for name, df in parts:
        row = df.agg(F.lit(name).alias("type"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- embedded arrays, manifests, calibration ------------------------------------------------
@query("SELECT page_id, CAST(page_id*10 + i AS VARCHAR) AS camera, concat('a ] b [', page_id) AS description FROM pages, (SELECT unnest([0, 1]) AS i)")
def extract_js_array(t):
    """Records of a JavaScript array inside whole web pages, with brackets in strings and text after it."""
    js = F.concat(
        F.lit("<script>var camMarker = [{'camera':'"), (F.col("page_id") * 10).cast("string"), F.lit("','description':'a ] b ["), F.col("page_id").cast("string"),
        F.lit("'},{'camera':'"), (F.col("page_id") * 10 + 1).cast("string"), F.lit("','description':'a ] b ["), F.col("page_id").cast("string"), F.lit("'}]; var z = [1];</script>"),
    )
    pages = t.pages.select("page_id", F.concat("html", js, "html").alias("html"))
    out = S.extract_js_array(pages, "html", "camMarker", "STRUCT<camera: STRING, description: STRING>")
    return out.select("page_id", "e.camera", "e.description")


@query("SELECT c_custkey AS camera, c_custkey % 4 AS quad, c_acctbal AS reproj FROM customer WHERE c_custkey % 3 <> 0")
def read_calibration(t):
    """Nested calibration maps to one row per calibrated quad; short matrices are left out."""
    h = F.when(F.col("c_custkey") % 3 != 0, F.array_repeat(F.lit(1.0), 9)).otherwise(F.array_repeat(F.lit(1.0), 8))
    quad = F.struct(h.alias("H"), F.lit(None).cast("array<struct<img: array<double>, scene: array<double>>>").alias("points"), F.col("c_acctbal").alias("reprojError"))
    cam = F.struct(F.lit("i").alias("intersection"), F.create_map((F.col("c_custkey") % 4).cast("string"), quad).alias("quads"))
    doc = t.customer.select(F.create_map(F.col("c_custkey").cast("string"), cam).alias("cameras"))
    out = S.explode_calibration(doc)
    return out.select(F.col("camera").cast("long").alias("camera"), F.col("quad").cast("long").alias("quad"), "reproj")


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN concat('m', p_partkey) ELSE concat('meshes/', p_partkey, '.bin') END AS mesh, p_partkey % 3 <> 0 AS visible FROM part")
def read_manifest(t):
    """Manifest tiles with aliased keys and defaults resolved."""
    j = F.concat(
        F.lit('{"tiles":[{"name":"'), F.col("p_partkey").cast("string"), F.lit('"'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"mesh_bin":"m'), F.col("p_partkey").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(',"visible":false')).otherwise(""), F.lit("}]}"),
    )
    doc = t.part.select(F.from_json(j, schemas.MANIFEST).alias("d")).select("d.*")
    return S.normalize_manifest(doc)["tiles"].select(F.col("name").cast("long").alias("name"), "mesh", "visible")


@query("SELECT c_name AS name, concat('meshes/', c_name, '.bin') AS mesh, s_nationkey % 2 = 0 AS visible FROM customer JOIN (SELECT concat('Customer#', substr(s_name, 10)) AS n, s_nationkey FROM supplier) ON n = c_name")
def merge_manifests(t):
    """Tiles in both the mesh and the scene table."""
    mesh = t.customer.select(F.col("c_name").alias("name"))
    scene = t.supplier.select(F.concat(F.lit("Customer#"), F.substr("s_name", F.lit(10))).alias("name"), (F.col("s_nationkey") % 2 == 0).alias("visible"))
    return S.merge_manifests(mesh, scene).select("name", "mesh", "visible")


@query("""SELECT p_partkey AS name, 'missing field: height' AS issue FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, concat('missing file: f', p_partkey) FROM part WHERE p_partkey % 9 = 0 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def verify_layer(t):
    """Rows of a layer without their file or a required field."""
    k = F.col("p_partkey")
    layer = t.part.select(k.alias("name"), F.when(k % 9 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("file"), F.when(k % 10 != 0, 1.0).alias("height"))
    files = t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"))
    return S.verify_layer(layer, files, ["height"])


@query("SELECT p_partkey, count(*) AS n, round(sum(l_quantity),2)+0.0 AS q FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def layer_round_trip(t):
    """A layer written as JSON documents and read back with its schema."""
    from ..session import scratch_path

    path = scratch_path(t.spark, "layer-")
    sums = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    cams = sums.select(F.col("l_partkey").cast("string").alias("id"), F.col("n").cast("string").alias("name"), F.col("q").alias("lat"))
    S.write_layer_json(cams, path, "cameras")
    back = S.read_layer_json(t.spark, path, "cameras")
    return back.select(F.col("id").cast("long").alias("p_partkey"), F.col("name").cast("long").alias("n"), r("lat", 2).alias("q"))
