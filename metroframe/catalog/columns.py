"""Projections, angles, names, text and predicates as Column expressions."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..fixtures import with_views
from ..functions import angles as N
from ..functions import camera as C
from ..functions import geo as P
from ..functions import predicates as Q
from ..functions import scalars as S
from ..operators import sets as O
from ..operators.transit import SCENE_A, SCENE_B
from .registry import query, r

_LL = "SELECT c_custkey AS id, -84.6149E0 + CAST((c_custkey*7907) % 10007 AS DOUBLE)/10007*0.22E0 AS lon, 37.96E0 + CAST((c_custkey*15485863) % 10007 AS DOUBLE)/10007*0.16E0 AS lat FROM {t}"


def places(t):
    return t.spark.sql(_LL.format(t="{t}"), t=t.customer)


_LLQ = "ll AS (" + _LL.format(t="customer") + ")"


def _series(coef, xi: str, eta: str, sign: str = "+") -> tuple[str, str]:
    a = "".join(f" {sign} {c!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, c in enumerate(coef, 1))
    b = "".join(f" {sign} {c!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, c in enumerate(coef, 1))
    return a, b


_A1, _A2 = _series(P._ALPHA, "xi", "eta")
_K = repr(P.UTM_K0 * P._RECT)
_UTM = f"""{_LLQ}, u1 AS (SELECT *, sin(radians(lat)) AS s, radians(lon + 87) AS dl FROM ll), u2 AS (SELECT *, sinh(atanh(s) - {P._E!r}*atanh({P._E!r}*s)) AS t FROM u1),
 u3 AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl)/sqrt(t*t+cos(dl)*cos(dl))) AS eta FROM u2), utm AS (SELECT id, lon, lat, 500000 + {_K}*(eta{_A2}) AS e, {_K}*(xi{_A1}) AS n FROM u3)"""


@query(f"WITH {_UTM} SELECT id, round(e,4)+0.0 AS e, round(n,4)+0.0 AS n FROM utm")
def lonlat_to_utm16n(t):
    e, n = P.lonlat_to_utm16n(F.col("lon"), F.col("lat"))
    return places(t).select("id", r(e, 4).alias("e"), r(n, 4).alias("n"))


@query(f"WITH {_LLQ} SELECT id, round(lon,7)+0.0 AS lon, round(lat,7)+0.0 AS lat FROM ll")
def utm16n_to_lonlat(t):
    """There and back again: the inverse returns the degrees it came from."""
    e, n = P.lonlat_to_utm16n(F.col("lon"), F.col("lat"))
    p = places(t).select("id", e.alias("e"), n.alias("n"))
    lon, lat = P.utm16n_to_lonlat(F.col("e"), F.col("n"))
    return p.select("id", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


@query(f"WITH {_UTM} SELECT id, round(e-719242.59,4)+0.0 AS x, round(4212857.25-n,4)+0.0 AS z FROM utm")
def utm_to_scene(t):
    x, z = P.lonlat_to_scene(F.col("lon"), F.col("lat"), SCENE_A, SCENE_B)
    return places(t).select("id", r(x, 4).alias("x"), r(z, 4).alias("z"))


@query(with_views("sites") + " SELECT site_id, round(719242.59+x,6)+0.0 AS e, round(4212857.25-z,6)+0.0 AS n FROM fx_sites")
def scene_to_utm(t):
    e, n = P.scene_to_utm(F.col("x"), F.col("z"), SCENE_A, SCENE_B)
    return t.sites.select("site_id", r(e).alias("e"), r(n).alias("n"))


@query(with_views("points") + " SELECT pid, l_partkey, l_suppkey, round((x*100-11.5)*0.01,6)+0.0 AS sx, round((y*100-33.5)*0.01,6)+0.0 AS sy, round((z*100+22.5)*0.01,6)+0.0 AS sz, round(x*100+11.5,6)+0.0 AS ux FROM fx_points")
def ue_cm_to_scene(t):
    o = (11.5, -22.5, 33.5)
    x, y, z = P.ue_cm_to_scene(F.col("x") * 100, F.col("z") * 100, F.col("y") * 100, o)
    back = P.scene_to_ue_cm(F.col("x"), F.col("y"), F.col("z"), o)
    return t.points.select("pid", "l_partkey", "l_suppkey", r(x).alias("sx"), r(y).alias("sy"), r(z).alias("sz"), r(back[0]).alias("ux"))


@query()
def stateplane_ky_to_utm(t):
    """Kentucky Single Zone feet to UTM; the check is a unit test (no stored golden value exists)."""
    x, y = F.col("x") + 5_250_000, F.col("z") + 3_900_000
    e, n = P.stateplane_ky_to_utm(x, y)
    return t.sites.select("site_id", r(e, 3).alias("e"), r(n, 3).alias("n"), r(P.ftus_to_m(F.col("x"))).alias("z_m"))


@query(f"WITH {_LLQ}, g AS (SELECT *, 6378137/sqrt(1-{P.WGS84_F * (2 - P.WGS84_F)!r}*sin(radians(lat))*sin(radians(lat))) AS n FROM ll) SELECT id, round((n+250)*cos(radians(lat))*cos(radians(lon)),4)+0.0 AS x, "
       f"round((n+250)*cos(radians(lat))*sin(radians(lon)),4)+0.0 AS y, round((n*{1 - P.WGS84_F * (2 - P.WGS84_F)!r}+250)*sin(radians(lat)),4)+0.0 AS z FROM g")
def geodetic_to_ecef(t):
    x, y, z = P.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.lit(250.0))
    return places(t).select("id", r(x, 4).alias("x"), r(y, 4).alias("y"), r(z, 4).alias("z"))


_M = [0.9, 0.1, -0.2, 0.0, 0.3, 0.8, 0.4, 0.0, -0.5, 0.2, 0.7, 0.0, 10.0, 20.0, 30.0, 1.0]


@query(with_views("points") + " SELECT pid, l_partkey, l_suppkey, round(0.9*x+0.3*y-0.5*z+10,6)+0.0 AS ax, round(0.1*x+0.8*y+0.2*z+20,6)+0.0 AS ay, round(-0.2*x+0.4*y+0.7*z+30,6)+0.0 AS az FROM fx_points")
def apply_affine4(t):
    a, b, c = P.apply_affine4(_M, F.col("x"), F.col("y"), F.col("z"))
    return t.points.select("pid", "l_partkey", "l_suppkey", r(a).alias("ax"), r(b).alias("ay"), r(c).alias("az"))


@query(with_views("sites") + """, a AS (SELECT site_id, x, z, radians(site_id % 90) AS p, radians(site_id % 360) AS y, radians(site_id % 45) AS w FROM fx_sites)
 SELECT site_id, round(x*(cos(p)*cos(y)) + 5*(sin(w)*sin(p)*cos(y)-cos(w)*sin(y)) + z*(-(cos(w)*sin(p)*cos(y)+sin(w)*sin(y))),6)+0.0 AS rx,
 round(x*(cos(p)*sin(y)) + 5*(sin(w)*sin(p)*sin(y)+cos(w)*cos(y)) + z*(cos(y)*sin(w)-cos(w)*sin(p)*sin(y)),6)+0.0 AS ry, round(x*sin(p) + 5*(-sin(w)*cos(p)) + z*(cos(w)*cos(p)),6)+0.0 AS rz FROM a""")
def rotator_matrix(t):
    i = F.col("site_id")
    m = P.rotator_matrix(i % 90, i % 360, i % 45)
    x, y, z = P.apply_rotation(m, F.col("x"), F.lit(5.0), F.col("z"))
    return t.sites.select("site_id", r(x).alias("rx"), r(y).alias("ry"), r(z).alias("rz"))


# ---- angles ------------------------------------------------------------------------
@query(with_views("sites") + """, a AS (SELECT site_id, x-500 AS dx, z-500 AS dz, CAST(site_id % 720 AS DOUBLE) AS b, CAST(site_id % 37 AS DOUBLE)/2-9 AS q FROM fx_sites)
 SELECT site_id, round(degrees(atan2(-dz,dx)),6)+0.0 AS heading, round(atan2(cos(radians(b)),sin(radians(b))),6)+0.0 AS yaw, round(q - 2*pi()*CASE WHEN q > pi() THEN ceil((q-pi())/(2*pi())) WHEN q < -pi() THEN -ceil((-q-pi())/(2*pi())) ELSE 0 END,6)+0.0 AS wrapped,
 round(abs(atan2(sin(q-1),cos(q-1))),6)+0.0 AS diff, round(degrees(q)-360*floor(degrees(q)/360),1)+0.0 AS h360, round(dx*cos(q)-dz*sin(q),6)+0.0 AS fwd, round(dx*sin(q)+dz*cos(q),6)+0.0 AS lat FROM a""")
def angle_helpers(t):
    """Heading, bearing, wrapping, difference and ego frame."""
    i = F.col("site_id")
    dx, dz, q = F.col("x") - 500, F.col("z") - 500, (i % 37).cast("double") / 2 - 9
    fwd, lat = N.ego_frame(dx, dz, q)
    return t.sites.select(
        "site_id", r(N.heading_from_motion(dx, dz)).alias("heading"), r(N.yaw_from_bearing((i % 720).cast("double"))).alias("yaw"),
        r(N.wrap_pi(q)).alias("wrapped"), r(N.angle_diff(q, F.lit(1.0))).alias("diff"), (N.heading_360(q) + 0.0).alias("h360"),
        r(fwd).alias("fwd"), r(lat).alias("lat"),
    )


# ---- grids and names ---------------------------------------------------------------
@query(with_views("sites") + " SELECT site_id, CAST(floor((x-500)/18) AS BIGINT) AS fx, CAST(trunc((x-500)/18) AS BIGINT) AS tx, greatest(least(CAST(trunc((x-500)/18) AS BIGINT),9),0) AS cx, CAST(round_even((x-500)/4,0) AS BIGINT) AS wx FROM fx_sites")
def grid_cells(t):
    """The floor, truncating and clamping cell forms, and the half-to-even weld key."""
    x, z = F.col("x") - 500, F.col("z")
    return t.sites.select(
        "site_id", S.grid_cell(x, z, 18.0)[0].alias("fx"), S.grid_cell(x, z, 18.0, mode="trunc")[0].alias("tx"),
        S.grid_cell(x, z, 18.0, mode="clamp", nx=10, nz=10)[0].alias("cx"), S.weld_key(x, z)[0].alias("wx"),
    )


@query(with_views("sites") + " SELECT site_id, concat('B-', 15626+26*CAST(floor((x*100+91525.0)/2600) AS BIGINT), 'E-', 185064+2640*CAST(floor((z*100-50000+170396.5)/2640) AS BIGINT), 'N') AS tile FROM fx_sites")
def tile_name(t):
    return t.sites.select("site_id", S.tile_name(F.col("x") * 100, F.col("z") * 100 - 50000).alias("tile"))


@query("WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) SELECT p_partkey, concat(p_name, '-', CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END) AS name FROM n")
def sequence_name(t):
    from ..plans.ordered import block_of

    return S.sequence_name(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"], block_of("p_partkey", 512)).select("p_partkey", "name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) + 0.5 WHEN p_partkey % 4 = 1 THEN p_size*3.5E0 WHEN p_partkey % 4 = 2 THEN NULL ELSE NULL END AS h FROM part""")
def tag_height(t):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    tags = (
        F.when(k == 0, F.create_map(F.lit("height"), F.concat(size, F.lit(".5 m"))))
        .when(k == 1, F.create_map(F.lit("building:levels"), size))
        .when(k == 2, F.create_map(F.lit("height"), F.lit("tall")))
        .otherwise(F.create_map(F.lit("name"), F.lit("x")))
    )
    return t.part.select("p_partkey", tags.alias("tags")).select("p_partkey", S.tag_height(F.col("tags")).alias("h"))


@query(with_views("roads") + """ SELECT DISTINCT class, CASE class WHEN 'primary' THEN 13.0E0 WHEN 'secondary' THEN 11.0E0 WHEN 'tertiary' THEN 9.0E0 WHEN 'residential' THEN 7.5E0 ELSE 5.5E0 END AS width,
 CASE class WHEN 'primary' THEN 4 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 2 WHEN 'residential' THEN 1 ELSE 0 END AS rank, class AS rank_name FROM fx_roads""")
def class_lookup(t):
    c = F.col("class")
    return t.roads.select("class", S.class_width(c).alias("width"), S.class_rank(c).alias("rank"), S.rank_name(S.class_rank(c)).alias("rank_name")).distinct()


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'incoming_at' WHEN 1 THEN 'stopped_at' WHEN 2 THEN 'in_transit_to' END AS status, CASE event_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'many_seats' WHEN 2 THEN 'few_seats' WHEN 3 THEN 'standing_room' WHEN 4 THEN 'crushed_standing' WHEN 5 THEN 'full' WHEN 6 THEN 'not_accepting' END AS occupancy FROM events")
def decode_enum(t):
    i = F.col("event_id")
    return t.events.select("event_id", S.decode_enum(i % 5, "vehicle_status").alias("status"), S.decode_enum(i % 8, "occupancy").alias("occupancy"))


@query(with_views("detections") + """ SELECT det_id, CASE cls WHEN 0 THEN 'ped' WHEN 2 THEN 'car' WHEN 3 THEN 'moto' WHEN 5 THEN 'bus' ELSE 'truck' END AS type, CASE cls WHEN 0 THEN 0.6E0 WHEN 2 THEN 4.5E0 WHEN 3 THEN 2.2E0 WHEN 5 THEN 12.0E0 ELSE 8.0E0 END AS length_m FROM fx_detections""")
def vehicle_dims(t):
    return S.vehicle_dims(t.detections, "cls").select("det_id", "type", "length_m")


# ---- text --------------------------------------------------------------------------
@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role ELSE concat('x', role) END AS t FROM conversations")
def translated_text(t):
    """English text of a translation list, else its first."""
    def tr(text, lang):
        return F.struct(F.col(text).alias("Text") if isinstance(text, str) else text.alias("Text"), F.lit(lang).cast("string").alias("Language"))

    other = F.concat(F.lit("x"), F.col("role"))
    lists = (
        F.when(F.col("turn") % 3 == 0, F.array(tr("role", "fr"), tr("text", "en-US")))
        .when(F.col("turn") % 3 == 1, F.array(tr("role", None), tr("text", "de")))
        .otherwise(F.array(tr(other, "de"), tr("text", "fr")))
    )
    return t.conversations.select("conv_id", "turn", lists.alias("l")).select("conv_id", "turn", S.translated_text(F.col("l")).alias("t"))


_TILES = """SELECT page_id, concat('N', CAST(page_id AS VARCHAR(20))) AS tile, CASE WHEN page_id % 3 = 0 THEN 'None' WHEN page_id % 3 = 1 THEN url ELSE '' END AS phase3_aws_url, 2025 AS phase3_year,
 CASE WHEN page_id % 2 = 0 THEN url END AS phase2_aws_url, 2019 AS phase2_year, CASE WHEN page_id % 5 = 0 THEN url END AS phase1_aws_url, 2010 AS phase1_year FROM {t}"""


def tiles(t):
    return t.spark.sql(_TILES.format(t="{t}"), t=t.pages)


_PICK = "t AS (" + _TILES.format(t="pages") + "), p AS (SELECT page_id, tile, phase2_aws_url, CASE WHEN page_id % 3 = 1 THEN 'phase3' WHEN page_id % 2 = 0 THEN 'phase2' WHEN page_id % 5 = 0 THEN 'phase1' END AS phase FROM t), q AS (SELECT *, CASE phase WHEN 'phase3' THEN 2025 WHEN 'phase2' THEN 2019 WHEN 'phase1' THEN 2010 END AS year FROM p)"


@query(f"WITH {_PICK} SELECT page_id, phase, year FROM q")
def pick_phase(t):
    return S.pick_phase(tiles(t)).select("page_id", "phase", "year")


@query(f"WITH {_PICK} SELECT tile, year, phase FROM q WHERE phase IS NOT NULL")
def list_tiles(t):
    """Tiles with a usable link."""
    from ..operators.rasters import list_tiles as lister

    return lister(tiles(t)).select("tile", "year", "phase")


@query(f"WITH {_PICK} SELECT year, count(*) AS tiles FROM q WHERE phase IS NOT NULL GROUP BY year")
def tiles_per_year(t):
    from ..operators.rasters import list_tiles as lister
    from ..operators.rasters import tiles_per_year as per

    return per(lister(tiles(t)))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END), ''), '3b82c4') AS label, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 9999 END AS ord FROM part")
def clean_text(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    ordv = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 4 == 1, "12a").otherwise("")
    return t.part.select("p_partkey", S.clean_text(raw, "3b82c4").alias("label"), S.sort_order(ordv).alias("ord"))


@query("SELECT page_id, regexp_replace(concat(split_part(url, '#', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'size=352x240&n=1'), '([?&]size=)[0-9]+x[0-9]+', '\\1960x720') AS still FROM pages")
def rewrite_query_param(t):
    base = F.substring_index("url", "#", 1)
    url = F.concat(base, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("size=352x240&n=1"))
    return t.pages.select("page_id", url.alias("u")).select("page_id", S.rewrite_query_param(F.col("u"), "size", "960x720").alias("still"))


@query("""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS url FROM pages), s AS (SELECT page_id, concat('/', array_to_string(list_slice(string_split(split_part(url, '?', 1), '/'), 4, 99), '/')) AS path, CASE WHEN contains(url, '?') THEN split_part(url, '?', 2) ELSE '' END AS q FROM u),
 f AS (SELECT page_id, path, list_sort(list_filter(list_concat(string_split(q, '&'), ['zz=1']), lambda e: contains(e, '=') AND NOT starts_with(e, 'ref=') AND NOT ends_with(e, '='))) AS l FROM s) SELECT page_id, sha1(concat(path, '?', array_to_string(l, '&'))) AS sig FROM f""")
def cache_signature(t):
    """Stable key of a URL: path and sorted query without volatile parameters."""
    base = F.substring_index("url", "#", 1)
    url = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("zz=1&ref=s"))
    return t.pages.select("page_id", S.cache_signature(url, ("ref", "session")).alias("sig"))


@query("WITH h AS (SELECT c_custkey, c_name, md5(c_name) AS h FROM customer) SELECT c_custkey, CAST((CAST(concat('0x', h[1:15]) AS UBIGINT)::UHUGEINT * 295147905179352825856::UHUGEINT % 97 + CAST(concat('0x', h[16:31]) AS UBIGINT)::UHUGEINT * 16 % 97 + CAST(concat('0x', h[32:32]) AS UBIGINT)) % 97 AS BIGINT) AS off FROM h")
def hash_offset(t):
    """md5 of an id as one big number, modulo the cycle."""
    return t.customer.select("c_custkey", S.hash_offset(F.col("c_name"), F.lit(97)).alias("off"))


@query("SELECT p_partkey, CAST(list_reduce(list_transform(range(1, length(p_brand)+1), lambda i: CAST(ascii(p_brand[i]) AS BIGINT)), lambda a, b: (a*31+b) % 4294967296, 0::BIGINT) % 360 AS BIGINT) AS hue FROM part")
def hash_hue(t):
    return t.part.select("p_partkey", S.hash_hue(F.col("p_brand")).alias("hue"))


@query("SELECT event_id, event_id % 4 > 1 AS ok FROM events")
def is_finite(t):
    i = F.col("event_id") % 4
    v = F.when(i == 0, "abc").when(i == 1, "NaN").when(i == 2, F.col("value").cast("string")).otherwise("1e3")
    return t.events.select("event_id", C.finite(v).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE least(greatest(value/10,0.0),1.0) END AS throttle, least(greatest(value/10-3,-1.0),1.0) AS steer FROM events")
def clamp_controls(t):
    bad = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 10)
    rows = t.events.select("event_id", bad.alias("throttle"), (F.col("value") / 10 - 3).alias("steer"))
    return S.clamp_controls(rows)


@query("""SELECT event_id, CAST(epoch(ts) AS BIGINT) - 1704067200 - event_id*20 AS eta_sec, CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 - event_id*20)/60.0E0+0.5) AS BIGINT) AS eta_min,
 (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 - event_id*20) > -120 AND (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 - event_id*20) < 3600 AS due FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def eta(t):
    """Seconds and minutes to arrival, and the horizon test."""
    a, now = F.unix_seconds("ts"), F.lit(1704067200) + F.col("event_id") * 20
    return t.events.select("event_id", S.eta_seconds(a, now).alias("eta_sec"), S.eta_minutes(a, now).alias("eta_min"), Q.arrival_in_horizon(a, now).alias("due"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('drive to the ', p_name, ' stop') ELSE concat('drive to ', p_name) END AS instruction FROM part")
def instruction_text(t):
    p = t.part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "stop").otherwise("street").alias("kind"))
    return S.instruction_text(p).select("p_partkey", "instruction")


# ---- predicates ----------------------------------------------------------------------
@query(with_views("points") + " SELECT pid, x, z, y FROM fx_points WHERE cls IN (1, 6)")
def class_filter(t):
    return t.points.where(Q.ground_class(F.col("cls"), (1, 6))).select("pid", "x", "z", "y")


@query(with_views("sites") + " SELECT site_id FROM fx_sites WHERE x BETWEEN 180 AND 620 AND z BETWEEN 280 AND 720")
def in_bbox(t):
    return t.sites.where(Q.in_bbox(F.col("x"), F.col("z"), (200.0, 300.0, 600.0, 700.0), 20.0)).select("site_id")


@query(with_views("roads") + " SELECT DISTINCT road_id FROM fx_roads WHERE class IN ('primary','secondary','tertiary','residential') OR (class = 'service' AND road_id % 3 <> 0)")
def keep_highway(t):
    name = F.when(F.col("road_id") % 3 != 0, F.col("name"))
    return t.roads.where(Q.keep_highway(F.col("class"), name, service=True)).select("road_id").distinct()


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 1, 2)")
def boardable(t):
    i = F.col("s_suppkey") % 4
    loc = F.when(i == 0, "").when(i == 1, "0").when(i == 3, "1")
    return t.supplier.where(Q.boardable(loc)).select("s_suppkey")


@query("SELECT event_id FROM events WHERE 1706000000 - floor(epoch(ts)) <= 86400")
def fresh(t):
    return t.events.where(Q.fresh(F.unix_seconds("ts"), F.lit(1706000000), 86400)).select("event_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')")
def text_match(t):
    return t.part.where(Q.text_match(" RED ", F.col("p_name"), F.col("p_brand"))).select("p_partkey")


@query(with_views("detections") + " SELECT det_id, cls FROM fx_detections WHERE cls IN (2,3,5,7)")
def flow_class(t):
    return t.detections.where(Q.flow_class(F.col("cls"))).select("det_id", "cls")


# ---- sorts, unions -------------------------------------------------------------------
@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY regexp_extract(lower(p_brand), '^([^0-9]*)', 1), TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_brand, p_partkey) AS rank FROM part")
def natural_order(t):
    """Brands with "Brand#9" before "Brand#10"."""
    key = S.numeric_aware_key(F.col("p_brand"))
    return O.ranked(t.part.select("p_partkey", "p_brand"), *key, F.col("p_brand"), F.col("p_partkey"))


@query("SELECT event_id, value, row_number() OVER (ORDER BY CASE WHEN value > 50 THEN NULL ELSE value END ASC NULLS LAST, event_id) AS rank FROM events")
def nulls_last_order(t):
    v = F.when(F.col("value") <= 50, F.col("value"))
    return O.ranked(t.events.select("event_id", "value"), v.asc_nulls_last(), F.col("event_id"))


@query("SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def union_keep_last(t):
    p = t.part.select("p_name", "p_partkey", "p_size")
    return O.union_keep_last([p.where("p_size <= 25").drop("p_size"), p.where("p_size > 25").drop("p_size"), p.drop("p_size")], ["p_name"], ["p_partkey"])


@query("SELECT p_name, coalesce(min(p_partkey) FILTER (p_size <= 25), min(p_partkey)) AS p_partkey FROM part GROUP BY p_name")
def union_keep_first(t):
    p = t.part.select("p_name", "p_partkey", "p_size")
    return O.union_keep_first([p.where("p_size <= 25").drop("p_size"), p.drop("p_size")], ["p_name"], ["p_partkey"])


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer UNION ALL SELECT -c_custkey-1, c_acctbal FROM customer WHERE c_acctbal < 500")
def upsert(t):
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = base.where("v > 5000").withColumn("v", F.col("v") + 1).unionByName(base.where("v < 500").withColumn("k", -F.col("k") - 1))
    return O.upsert(base, new, ["k"])


@query("SELECT conv_id, 'train' AS split FROM conversations WHERE conv_id BETWEEN 0 AND 39 UNION ALL SELECT conv_id, 'test' FROM conversations WHERE conv_id BETWEEN 60 AND 79")
def split_ids(t):
    return O.split_ids(t.conversations.select("conv_id"), 40, 20, 60, "conv_id")


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id BETWEEN 0 AND 39 INTERSECT SELECT DISTINCT conv_id FROM conversations WHERE conv_id BETWEEN 60 AND 79)")
def split_disjoint(t):
    s = O.split_ids(t.conversations.select("conv_id"), 40, 20, 60, "conv_id")
    return s.where("split = 'train'").select("conv_id").intersect(s.where("split = 'test'").select("conv_id")).agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_difference(t):
    hit = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return t.customer.select("c_custkey").join(hit, "c_custkey", "left_anti").distinct()


# ---- homographies as columns ------------------------------------------------------------
_H = [245.4, -167.3, 666.4, 2837.2, -1488.5, 7440.9, 0.378, -0.198, 1.0]
_W = "(0.378*u-0.198*v+1)"


@query(with_views("detections") + f" SELECT det_id, round((245.4*u-167.3*v+666.4)/{_W},6)+0.0 AS x, round((2837.2*u-1488.5*v+7440.9)/{_W},6)+0.0 AS z FROM fx_detections")
def apply_homography(t):
    h = F.array(*[F.lit(v) for v in _H])
    x, z = C.apply_homography(h, F.col("u"), F.col("v"))
    return t.detections.select("det_id", r(x).alias("x"), r(z).alias("z"))


@query(with_views("detections") + " SELECT det_id, round(u,6)+0.0 AS u, round(v,6)+0.0 AS v FROM fx_detections")
def invert_homography(t):
    """Image point to scene and back."""
    h = F.array(*[F.lit(v) for v in _H])
    x, z = C.apply_homography(h, F.col("u"), F.col("v"))
    d = t.detections.select("det_id", x.alias("x"), z.alias("z"))
    u, v = C.apply_homography(C.invert_homography(h), F.col("x"), F.col("z"))
    return d.select("det_id", r(u).alias("u"), r(v).alias("v"))


@query(with_views("detections") + """ SELECT det_id, CASE WHEN v < 0.5 THEN 0 ELSE 2 END + CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS q, round((u-CASE WHEN u < 0.5 THEN 0 ELSE 0.5 END)*2,6)+0.0 AS qu, round(u,6)+0.0 AS u2, round(v,6)+0.0 AS v2,
 round((u+v)/2/640,8)+0.0 AS tu, round(v/360,8)+0.0 AS tv FROM fx_detections""")
def quad_layout(t):
    """Quad of a full-frame point, the way back, and the tyre point of a box."""
    q, qu, qv = C.quad_of(F.col("u"), F.col("v"))
    d = t.detections.select("det_id", "u", "v", q.alias("q"), qu.alias("qu"), qv.alias("qv"))
    u2, v2 = C.quad_to_full(F.col("q"), F.col("qu"), F.col("qv"))
    tu, tv = C.tire_point(F.array("u", F.lit(0.0), "v", "v"), 640, 360)
    return d.select("det_id", "q", r("qu").alias("qu"), r(u2).alias("u2"), r(v2).alias("v2"), r(tu, 8).alias("tu"), r(tv, 8).alias("tv"))


