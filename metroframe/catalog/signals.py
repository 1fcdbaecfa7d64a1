"""Signal plans on cyclic time: one plan per nation, read at event times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..operators import signals as G
from .registry import query, r


def plans(t):
    """Two-group ring per nation with ranks and widths from its key."""
    k = F.col("n_nationkey")
    g = F.array(
        F.struct(F.lit("A").alias("label"), (k % 5).alias("rank"), (7.0 + k % 9).alias("width")),
        F.struct(F.lit("B").alias("label"), ((k + 2) % 5).alias("rank"), (9.0 + k % 6).alias("width")),
    )
    return G.phase_plan(t.nation.select(k.cast("string").alias("id"), "n_nationkey", g.alias("groups")))


_GREEN = "CASE {r} WHEN 4 THEN 28 WHEN 3 THEN 24 WHEN 2 THEN 18 WHEN 1 THEN 16 ELSE 14 END"
_PLAN = f"""na AS (SELECT n_nationkey AS k, md5(CAST(n_nationkey AS VARCHAR)) AS h, {_GREEN.format(r='n_nationkey % 5')} AS ga, {_GREEN.format(r='(n_nationkey+2) % 5')} AS gb,
  CAST(ceil((9.0E0 + n_nationkey % 6)/1.2E0) AS INTEGER) - 6 AS needb, CAST(ceil((7.0E0 + n_nationkey % 9)/1.2E0) AS INTEGER) - 6 AS needa FROM nation),
 fl AS (SELECT *, greatest(3, least(ga-7, needb)) AS fa, greatest(3, least(gb-7, needa)) AS fb FROM na),
 cy AS (SELECT *, ga+gb+12 AS cycle, (ga+gb+12)::UHUGEINT AS m FROM fl),
 pl AS (SELECT *, CAST((CAST(concat('0x', h[1:15]) AS UBIGINT)::UHUGEINT * (295147905179352825856::UHUGEINT % m) % m + CAST(concat('0x', h[16:31]) AS UBIGINT)::UHUGEINT * 16 % m + CAST(concat('0x', h[32:32]) AS UBIGINT)) % m AS BIGINT) AS off FROM cy),
 ph AS (SELECT k, cycle, off, unnest([{{'i':0,'d':ga-fa,'a':'green','b':'red','pa':'dont','pb':'walk'}},{{'i':1,'d':fa,'a':'green','b':'red','pa':'dont','pb':'flash'}},{{'i':2,'d':4,'a':'yellow','b':'red','pa':'dont','pb':'dont'}},{{'i':3,'d':2,'a':'red','b':'red','pa':'dont','pb':'dont'}},
  {{'i':4,'d':gb-fb,'a':'red','b':'green','pa':'walk','pb':'dont'}},{{'i':5,'d':fb,'a':'red','b':'green','pa':'flash','pb':'dont'}},{{'i':6,'d':4,'a':'red','b':'yellow','pa':'dont','pb':'dont'}},{{'i':7,'d':2,'a':'red','b':'red','pa':'dont','pb':'dont'}}]) AS p FROM pl),
 iv AS (SELECT k, cycle, off, p.i AS i, p.a AS a, p.b AS b, p.pa AS pa, p.pb AS pb, sum(p.d) OVER (PARTITION BY k ORDER BY p.i) AS e, p.d AS d FROM ph)"""


@query(f"WITH {_PLAN} SELECT k AS n_nationkey, i, a, b, pa, pb, CAST(d AS INTEGER) AS d, CAST(cycle AS INTEGER) AS cycle, off FROM iv")
def phase_plan(t):
    """Every phase of every plan."""
    p = plans(t).select("n_nationkey", "cycle", "offset", F.posexplode("phases").alias("i", "p"))
    return p.select(
        "n_nationkey", "i", F.col("p.groupStates")["A"].alias("a"), F.col("p.groupStates")["B"].alias("b"), F.col("p.pedStates")["A"].alias("pa"),
        F.col("p.pedStates")["B"].alias("pb"), F.col("p.durSec").alias("d"), "cycle", F.col("offset").alias("off"),
    )


def asked(t):
    e = t.events
    return e.select(
        "event_id", (F.col("event_id") % 25).cast("string").alias("id"), F.unix_seconds("ts").cast("double").alias("t"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("group"),
    )


_ASK = f"""{_PLAN}, q AS (SELECT event_id, event_id % 25 AS k, floor(epoch(ts)) AS t, event_id % 2 = 0 AS is_a FROM events),
 l AS (SELECT q.*, cycle, (t + off) % cycle AS loc FROM q JOIN pl USING (k)),
 s AS (SELECT l.event_id, l.is_a, l.k, l.cycle, l.loc, iv.i, iv.e - l.loc AS left_, CASE WHEN is_a THEN a ELSE b END AS signal, CASE WHEN is_a THEN pa ELSE pb END AS ped FROM l JOIN iv ON iv.k = l.k AND l.loc >= iv.e - iv.d AND l.loc < iv.e)"""


@query(f"WITH {_ASK} SELECT event_id, signal, ped, CAST(i AS INTEGER) AS phase, CAST(left_ AS DOUBLE) AS sec_left FROM s")
def signal_state_at(t):
    """State of a group at each event's second."""
    return G.signal_state_at(asked(t), plans(t)).select("event_id", "signal", "ped", "phase", "sec_left")


_CHANGE = """, nx AS (SELECT s.event_id, min(CASE WHEN iv.i > s.i THEN iv.e - iv.d - s.loc ELSE iv.e - iv.d - s.loc + s.cycle END) AS sec FROM s JOIN iv ON iv.k = s.k AND (CASE WHEN s.is_a THEN iv.a ELSE iv.b END) <> s.signal GROUP BY s.event_id)"""


@query(f"WITH {_ASK}{_CHANGE} SELECT event_id, CAST(sec AS DOUBLE) AS sec_to_change FROM nx")
def sec_to_change(t):
    return G.sec_to_change(asked(t), plans(t)).select("event_id", "sec_to_change")


def legs(t):
    """One leg per event: control from the key, overrides on every eleventh nation."""
    return asked(t).select(
        "event_id", "id", F.lit(0).alias("leg_idx"), "group", "t",
        F.when(F.col("event_id") % 3 == 0, "signal").when(F.col("event_id") % 3 == 1, "stop").otherwise("uncontrolled").alias("control"),
    )


def overrides(t):
    k = F.col("n_nationkey")
    states = F.create_map(F.lit("A"), F.lit("red"), F.lit("B"), F.lit("green"))
    return t.nation.where(k % 11 == 0).select(k.cast("string").alias("id"), states.alias("groupStates"), F.lit(None).cast("map<string,string>").alias("pedStates"))


@query(f"""WITH {_ASK}{_CHANGE}, o AS (SELECT s.event_id, CASE WHEN s.event_id % 3 = 0 THEN CASE WHEN k % 11 = 0 THEN CASE WHEN is_a THEN 'red' ELSE 'green' END ELSE signal END END AS signal,
 CASE WHEN s.event_id % 3 = 0 THEN CASE WHEN k % 11 = 0 THEN 'dont' ELSE ped END END AS ped, CASE WHEN s.event_id % 3 = 0 THEN CAST(sec AS DOUBLE) END AS sec_to_change FROM s JOIN nx USING (event_id))
 SELECT event_id, signal, ped, sec_to_change, CASE WHEN event_id % 3 = 0 THEN coalesce(signal = 'green', false) ELSE event_id % 3 = 2 END AS can_proceed FROM o""")
def leg_state(t):
    """Leg states with overrides winning over the plan."""
    return G.leg_state(legs(t), plans(t), overrides=overrides(t)).select("event_id", "signal", "ped", "sec_to_change", "can_proceed")


def stop_points(t):
    return t.targets.select(
        F.col("target_id").alias("leg_key"), (F.col("x") / 5).alias("x"), (F.col("z") / 5).alias("z"), (F.col("target_id") % 25).cast("string").alias("id"),
        F.lit(0).alias("leg_idx"), F.lit("signal").alias("control"), F.when(F.col("target_id") % 2 == 0, "A").otherwise("B").alias("group"),
    )


_LEGS = f"""{with_views("poses", "targets")}, {_PLAN}, p AS (SELECT event_id, x, z, yaw, floor(epoch(ts)) AS t FROM fx_poses), g AS (SELECT target_id AS leg_key, x/5 AS x, z/5 AS z, target_id % 25 AS k, target_id % 2 = 0 AS is_a FROM fx_targets)"""


@query(_LEGS + """, n AS (SELECT p.event_id, p.t, arg_min(leg_key, {'d': (p.x-g.x)*(p.x-g.x)+(p.z-g.z)*(p.z-g.z), 'k': leg_key}) AS leg_key FROM p, g WHERE (p.x-g.x)*(p.x-g.x)+(p.z-g.z)*(p.z-g.z) < 225 GROUP BY p.event_id, p.t)
 SELECT n.event_id, n.leg_key, CASE WHEN is_a THEN a ELSE b END AS signal FROM n JOIN g USING (leg_key) JOIN pl ON pl.k = g.k JOIN iv ON iv.k = g.k AND (t+pl.off) % pl.cycle >= iv.e-iv.d AND (t+pl.off) % pl.cycle < iv.e""")
def nearest_leg(t):
    """Signal of the nearest stop line within 15 m."""
    p = t.poses.select("event_id", "x", "z", F.unix_seconds("ts").cast("double").alias("t"))
    return G.nearest_leg(p, stop_points(t), plans(t), "event_id", max_r=15.0).select("event_id", "leg_key", "signal")


@query(_LEGS + """, c AS (SELECT p.event_id, p.t, g.*, (g.x-p.x)*cos(yaw)-(g.z-p.z)*sin(yaw) AS fwd, (g.x-p.x)*sin(yaw)+(g.z-p.z)*cos(yaw) AS side FROM p, g),
 n AS (SELECT event_id, t, arg_min({'key': leg_key, 'k': k, 'is_a': is_a}, {'f': fwd, 'l': leg_key}) AS best, min(fwd) AS far FROM c WHERE fwd > 0 AND fwd <= 22 AND abs(side) <= 4 GROUP BY event_id, t)
 SELECT n.event_id, best.key AS ahead_id, round(far,6)+0.0 AS ahead_dist, CASE WHEN best.is_a THEN iv.a ELSE iv.b END AS ahead_signal FROM n JOIN pl ON pl.k = best.k JOIN iv ON iv.k = best.k AND (t+pl.off) % pl.cycle >= iv.e-iv.d AND (t+pl.off) % pl.cycle < iv.e""")
def signal_ahead(t):
    """Stop line and its state in the lane ahead."""
    p = t.poses.select("event_id", "x", "z", "yaw", F.unix_seconds("ts").cast("double").alias("t"))
    out = G.signal_ahead(p, stop_points(t), plans(t), "event_id")
    return out.where("ahead_id is not null").select("event_id", "ahead_id", r("ahead_dist").alias("ahead_dist"), "ahead_signal")
