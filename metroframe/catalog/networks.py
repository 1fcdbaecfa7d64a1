"""Road graph, routes, walks and junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..functions.scalars import class_width, weld_key
from ..operators import clustering as C
from ..operators import graph as G
from ..operators import junctions as J
from ..operators import signals as S
from ..plans.ordered import block_of
from .registry import query, r

def blk():
    return block_of("seq", 64)


_GRAPH = """, k AS (SELECT road_id, seq, x, z, CAST(round_even(x/40,0) AS BIGINT)*4294967296 + CAST(round_even(z/40,0) AS BIGINT) + 2147483648 AS node FROM fx_roads),
 nodes AS (SELECT node, arg_min(x, {'r': road_id, 's': seq}) AS x, arg_min(z, {'r': road_id, 's': seq}) AS z FROM k GROUP BY node),
 st AS (SELECT node AS a, lead(node) OVER (PARTITION BY road_id ORDER BY seq) AS b FROM k),
 e1 AS (SELECT DISTINCT least(a,b) AS u, greatest(a,b) AS v FROM st WHERE b IS NOT NULL AND a <> b),
 e2 AS (SELECT u, v, sqrt((p.x-q.x)*(p.x-q.x)+(p.z-q.z)*(p.z-q.z)) AS w FROM e1 JOIN nodes p ON p.node = u JOIN nodes q ON q.node = v),
 edges AS (SELECT u AS src, v AS dst, w FROM e2 UNION ALL SELECT v, u, w FROM e2)"""


def graph(t):
    return G.build_road_graph(t.roads.select("road_id", "seq", "x", "z"), 40.0, block=blk())


@query(with_views("roads") + _GRAPH + " SELECT src, dst, round(w,6)+0.0 AS w FROM edges")
def build_road_graph(t):
    """Directed edges of the welded road graph."""
    return graph(t)[1].withColumn("w", r("w"))


@query(with_views("roads") + _GRAPH + " SELECT node, x, z FROM nodes")
def road_graph_nodes(t):
    return graph(t)[0]


@query(with_views("roads") + _GRAPH + " SELECT src AS node, count(DISTINCT dst) AS degree FROM edges GROUP BY src HAVING count(DISTINCT dst) >= 3")
def node_degree(t):
    return G.node_degree(graph(t)[1], 3)


_PAIRS = """, pairs AS (SELECT s_suppkey AS pair_id, CAST(s_suppkey*37 % 1000 AS DOUBLE) AS sx, CAST(s_suppkey*91 % 1000 AS DOUBLE) AS sz,
  CAST((s_suppkey*53 + 500) % 1000 AS DOUBLE) AS gx, CAST((s_suppkey*17 + 300) % 1000 AS DOUBLE) AS gz FROM supplier),
 s AS (SELECT pair_id, arg_min(node, hypot2) AS s_node, sqrt(min(hypot2)) AS s_off FROM (SELECT pair_id, node, (x-sx)*(x-sx)+(z-sz)*(z-sz) AS hypot2 FROM pairs, nodes) GROUP BY pair_id),
 g AS (SELECT pair_id, arg_min(node, hypot2) AS g_node, sqrt(min(hypot2)) AS g_off FROM (SELECT pair_id, node, (x-gx)*(x-gx)+(z-gz)*(z-gz) AS hypot2 FROM pairs, nodes) GROUP BY pair_id)"""


@query(with_views("roads").replace("WITH ", "WITH RECURSIVE ", 1) + _GRAPH + _PAIRS + """,
 way(start, node, d, hops) USING KEY (start, node) AS (SELECT DISTINCT s_node, s_node, CAST(0 AS DOUBLE), 1 FROM s
  UNION SELECT n.start, n.node, n.d, n.hops FROM (SELECT way.start, edges.dst AS node, min(way.d + edges.w) AS d, arg_min(way.hops + 1, way.d + edges.w) AS hops
   FROM way JOIN edges ON edges.src = way.node GROUP BY way.start, edges.dst) n
   LEFT JOIN recurring.way old ON old.start = n.start AND old.node = n.node WHERE old.d IS NULL OR n.d < old.d)
 SELECT pair_id, CAST(coalesce(hops, 0) AS INTEGER) AS hops, round(coalesce(d + s_off + g_off, sqrt((gx-sx)*(gx-sx)+(gz-sz)*(gz-sz))), 4) + 0.0 AS length, d IS NOT NULL AS snapped
 FROM pairs JOIN s USING (pair_id) JOIN g USING (pair_id) LEFT JOIN way ON way.start = s_node AND way.node = g_node""")
def shortest_path(t):
    """Road routes between two places of each supplier."""
    nodes, edges = graph(t)
    key = F.col("s_suppkey")
    places = {"sx": key * 37, "sz": key * 91, "gx": key * 53 + 500, "gz": key * 17 + 300}
    pairs = t.supplier.select(key.alias("pair_id"), *[(c % 1000).cast("double").alias(n) for n, c in places.items()])
    out = G.shortest_path(nodes, edges, pairs)
    return out.select("pair_id", F.size("path").alias("hops"), r("length", 4).alias("length"), "snapped")


@query()
def random_walks(t):
    """Six hops from the first vertex of every road."""
    _, edges = graph(t)
    kx, kz = weld_key(F.col("x"), F.col("z"), 40.0)
    at = (kx * F.lit(4294967296) + (kz + F.lit(2147483648))).alias("node")
    starts = t.roads.select("road_id", "seq", at).groupBy(F.col("road_id").alias("walk_id")).agg(F.min_by("node", "seq").alias("node"))
    return G.random_walks(edges, starts, 6, 3)


# ---- junctions -----------------------------------------------------------------------
def centers(t):
    """Road ends clustered within 6 m, as junction centres."""
    v = F.struct("o_orderkey", "x", "z")
    ends = t.roads.groupBy("road_id").agg(F.min_by(v, "seq").alias("a"), F.max_by(v, "seq").alias("b"))
    pts = ends.select(F.explode(F.array("a", "b")).alias("e")).select("e.*").distinct()
    lab = C.cluster_within(pts, 6.0, "o_orderkey")
    return C.cluster_centroids(pts, lab, "o_orderkey").select(F.col("cluster").alias("jid"), "x", "z")


def road_info(t):
    v = t.roads.select("road_id", "class", "name").distinct()
    return v.withColumn("width", class_width(F.col("class")))


def legs(t):
    return J.junction_legs(centers(t), t.roads, road_info(t), 3, blk())


@query()
def junction_legs(t):
    """Fused approaches of every junction with at least three."""
    out = legs(t)
    return out.select("jid", "idx", r("bearing").alias("bearing"), "rank", "class", "width", "name", r("reach", 4).alias("reach"))


def simple_legs(t):
    """Three or four legs per customer, from its key."""
    k = F.col("c_custkey")
    n = F.explode(F.sequence(F.lit(0), (2 + k % 2).cast("int")))
    base = t.customer.select(k.alias("jid"), n.alias("idx"))
    j, i = F.col("jid"), F.col("idx")
    turn = i * 1.6 + ((j * 7 + i * 3) % 10) / 40.0
    return base.select(
        "jid", "idx", F.atan2(F.sin(turn), F.cos(turn)).alias("bearing"), ((j + i) % 5).cast("int").alias("rank"), (6.0 + (j * 3 + i * 5) % 9).alias("width")
    )


_LEGSQL = """, l AS (SELECT c_custkey AS jid, i AS idx, i*1.6E0 + ((c_custkey*7+i*3) % 10)/40.0E0 AS b, (c_custkey+i) % 5 AS rank, 6.0E0 + (c_custkey*3+i*5) % 9 AS w FROM customer, (SELECT unnest([0,1,2,3]) AS i) WHERE i <= 2 + c_custkey % 2),
 x AS (SELECT a.jid, a.idx, max(o.w)/2 AS edge FROM l a JOIN l o ON o.jid = a.jid AND o.idx <> a.idx AND abs(atan2(sin(o.b-a.b),cos(o.b-a.b))) > radians(50) AND abs(abs(atan2(sin(o.b-a.b),cos(o.b-a.b)))-pi()) > radians(50) GROUP BY a.jid, a.idx)"""


def _greedy(order: str, gap: str) -> str:
    """Pairs of legs taken one by one: r (jid, legs, k, taken, pairs), complete where k = len(legs); pairs lists (n, idx)."""
    return f"""WITH RECURSIVE {_LEGSQL[2:]}, o AS (SELECT jid, list({{'idx': CAST(idx AS INTEGER), 'b': b, 'rank': rank}} ORDER BY {order}) AS legs FROM l GROUP BY jid),
 r AS (SELECT jid, legs, 0 AS k, CAST([] AS INTEGER[]) AS taken, 0 AS n, CAST([] AS STRUCT(n INTEGER, idx INTEGER)[]) AS pairs FROM o UNION ALL
  SELECT jid, legs, k + 1, CASE WHEN held THEN taken ELSE taken || mine END, CASE WHEN held THEN n ELSE n + 1 END, CASE WHEN held THEN pairs ELSE pairs || list_transform(mine, lambda i: {{'n': n, 'idx': i}}) END
  FROM (SELECT *, list_contains(taken, me.idx) AS held, [me.idx] || list_transform(list_slice(list_sort(list_transform(list_filter(legs, lambda q: q.idx <> me.idx AND NOT list_contains(taken, q.idx) AND pi() - abs(atan2(sin(me.b - q.b), cos(me.b - q.b))) < radians(30)),
   lambda q: {{'gap': {gap}, 'at': list_position(legs, q), 'idx': q.idx}})), 1, 1), lambda q: q.idx) AS mine
   FROM (SELECT *, legs[k + 1] AS me FROM r WHERE k < len(legs)))), done AS (SELECT * FROM r WHERE k = len(legs))"""


_STREETS = _greedy("idx", "0.0E0") + """, st AS (SELECT jid, len(legs) AS degree, n, list_transform(range(n), lambda g: list_max(list_transform(list_filter(pairs, lambda p: p.n = g), lambda p: list_filter(legs, lambda q: q.idx = p.idx)[1].rank))) AS tops FROM done),
 streets AS (SELECT jid, n AS streets, CAST(len(list_filter(tops, lambda v: v >= 2)) AS INTEGER) AS major, CAST(list_max(tops) AS INTEGER) AS top, CAST(degree AS INTEGER) AS degree FROM st)"""


@query(_greedy("rank DESC, w DESC, idx", "pi() - abs(atan2(sin(me.b - q.b), cos(me.b - q.b)))") + " SELECT jid, p.idx AS idx, chr(65 + p.n) AS grp FROM (SELECT jid, unnest(pairs) AS p FROM done)")
def pair_opposites(t):
    """Movement groups of opposing legs."""
    return J.pair_opposites(simple_legs(t))


@query(_STREETS + " SELECT * FROM streets")
def count_streets(t):
    return J.count_streets(simple_legs(t))


def _junctions(t):
    s = J.count_streets(simple_legs(t))
    return s.join(t.sites.select(F.col("site_id").alias("jid"), "x", "z"), "jid")


@query(_STREETS + """ SELECT jid, CASE WHEN top >= 3 AND major >= 2 THEN 'signal' WHEN top >= 2 OR degree >= 4 THEN 'stop' ELSE 'uncontrolled' END AS control,
 ['service', 'residential', 'tertiary', 'secondary', 'primary'][top + 1] AS controlling_class FROM streets""")
def classify_junctions(t):
    """Control by rank and degree alone."""
    return J.classify_junctions(_junctions(t)).select("jid", "control", "controlling_class")


_NEARSIG = """, s AS (SELECT DISTINCT site_id FROM fx_sites s, fx_targets t WHERE (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z) < 2025),
 g AS (SELECT c_custkey AS jid, 3 + c_custkey % 2 AS degree, greatest(c_custkey % 5, (c_custkey+1) % 5, (c_custkey+2) % 5, CASE WHEN c_custkey % 2 = 1 THEN (c_custkey+3) % 5 ELSE 0 END) AS top FROM customer)"""


@query(with_views("sites", "targets") + _NEARSIG + " SELECT jid, CASE WHEN site_id IS NOT NULL THEN 'signal' WHEN top >= 2 OR degree >= 4 THEN 'stop' ELSE 'uncontrolled' END AS control, CASE top WHEN 4 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 2 THEN 'tertiary' WHEN 1 THEN 'residential' ELSE 'service' END AS controlling_class FROM g LEFT JOIN s ON site_id = jid")
def classify_junctions_signals(t):
    """Control with real signals as ground truth."""
    sig = t.targets.select(F.col("target_id").alias("signal_id"), "x", "z")
    return J.classify_junctions(_junctions(t), sig).select("jid", "control", "controlling_class")


@query()
def enforce_spacing(t):
    """Signals closer than 45 m to a greater one become stops."""
    sig = t.targets.select(F.col("target_id").alias("signal_id"), "x", "z")
    return J.enforce_spacing(J.classify_junctions(_junctions(t), sig)).select("jid", "control")




@query(with_views("sites") + _LEGSQL + """ SELECT l.jid, CAST(l.idx AS INTEGER) AS idx, round(s.x + cos(b)*(coalesce(edge,w/2)+4) - sin(b)*w/4, 2)+0.0 AS stop_x, round(s.z + sin(b)*(coalesce(edge,w/2)+4) + cos(b)*w/4, 2)+0.0 AS stop_z, true AS marked FROM l LEFT JOIN x USING (jid, idx) JOIN fx_sites s ON s.site_id = l.jid""")
def approach_geometry(t):
    """Stop point of each leg."""
    c = t.sites.select(F.col("site_id").alias("jid"), "x", "z")
    out = J.approach_geometry(simple_legs(t), c)
    return out.select("jid", "idx", (F.col("stop_point.x") + 0.0).alias("stop_x"), (F.col("stop_point.z") + 0.0).alias("stop_z"), "marked")


@query()
def junction_phase_plans(t):
    """Phase plans of paired legs: one green at a time."""
    lg = simple_legs(t)
    plans = S.phase_plan(J.plan_groups(lg, J.pair_opposites(lg)))
    green = F.array_max(F.transform("phases", lambda p: F.size(F.filter(F.map_values(p["groupStates"]), lambda s: s == "green"))))
    return plans.select("id", "cycle", "offset", F.size("groups").alias("groups"), F.size("phases").alias("phases"), green.alias("greens"))


@query(with_views("sites") + _LEGSQL + " SELECT jid, max(rank) AS max_rank, max(w) AS max_width FROM l GROUP BY jid")
def group_max(t):
    from ..operators.aggregates import group_max as top

    return top(simple_legs(t).withColumn("rank", F.col("rank").cast("long")), ["jid"])
