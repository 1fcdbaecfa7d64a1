"""Traffic-signal plans on cyclic time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_offset, lookup
from .spatial import corridor_ahead, nearest_join

# Seconds of green by road rank, and clearance times: fixed values.
GREEN_SEC = {4: 28, 3: 24, 2: 18, 1: 16, 0: 14}
YELLOW_SEC, ALL_RED_SEC, WALK_SPEED, MIN_FLASH_SEC, MIN_WALK_SEC = 4, 2, 1.2, 3, 7


def phase_plan(groups: DataFrame) -> DataFrame:
    """Fixed-time ring of each junction: id, groups ARRAY<STRUCT<label, rank, width>> in order.

    Adds cycle, offset and phases ARRAY<STRUCT<groupStates, pedStates, durSec>>.  Each
    group is green once; the next group's crossing walks and then flashes meanwhile,
    long enough to finish before that group turns green.
    """
    g = F.col("groups")
    k = F.size(g)
    labels = F.transform(g, lambda v: v["label"])

    def states(special: Column, value: str, rest: str) -> Column:
        return F.map_from_arrays(labels, F.transform(labels, lambda lab: F.when(lab.eqNullSafe(special), value).otherwise(rest)))

    def ring(v: Column, i: Column) -> Column:
        nxt = F.when(k > 1, F.get(g, (i + 1) % k))
        green = F.coalesce(lookup(v["rank"].cast("int"), GREEN_SEC), F.lit(18))
        need = F.ceil(nxt["width"] / WALK_SPEED).cast("int") - (YELLOW_SEC + ALL_RED_SEC)
        flash = F.when(k > 1, F.greatest(F.lit(MIN_FLASH_SEC), F.least(green - MIN_WALK_SEC, need))).otherwise(0)
        go, stop = states(v["label"], "green", "red"), states(F.lit(None).cast("string"), "red", "red")
        wait = states(F.lit(None).cast("string"), "dont", "dont")

        def phase(veh: Column, ped: Column, dur: Column) -> Column:
            return F.struct(veh.alias("groupStates"), ped.alias("pedStates"), dur.cast("int").alias("durSec"))

        return F.array(
            phase(go, states(nxt["label"], "walk", "dont"), green - flash),
            phase(go, states(nxt["label"], "flash", "dont"), flash),
            phase(states(v["label"], "yellow", "red"), wait, F.lit(YELLOW_SEC)),
            phase(stop, wait, F.lit(ALL_RED_SEC)),
        )

    # a one-group ring has no flashing phase
    phases = F.filter(F.flatten(F.transform(g, ring)), lambda p: p["durSec"] > 0)
    out = groups.withColumn("phases", phases)
    cycle = F.aggregate("phases", F.lit(0), lambda acc, p: acc + p["durSec"])
    return out.withColumn("cycle", cycle).withColumn("offset", hash_offset(F.col("id"), F.col("cycle")))


def _timed(df: DataFrame, plans: DataFrame, t: str, key: str) -> DataFrame:
    """Rows joined with their plan: place in the cycle, phase number and seconds left."""
    ends = F.transform(
        F.sequence(F.lit(1), F.size("phases")),
        lambda i: F.aggregate(F.slice("phases", 1, i), F.lit(0.0), lambda acc, p: acc + p["durSec"]),
    )
    ready = plans.select(key, "cycle", "offset", "phases", ends.alias("_ends"))
    j = df.join(ready, key, "left")
    local = F.pmod(F.col(t).cast("double") + F.col("offset"), F.col("cycle").cast("double"))
    j = j.withColumn("_local", local)
    past = F.size(F.filter("_ends", lambda e: e <= F.col("_local")))
    j = j.withColumn("_i", F.least(past, F.size("phases") - 1))
    return j.withColumn("_left", F.greatest(F.get("_ends", F.col("_i")) - F.col("_local"), F.lit(0.0)))


def _now(what: str, group: Column) -> Column:
    return F.try_element_at(F.get("phases", F.col("_i"))[what], group)


_HELPERS = ("cycle", "offset", "phases", "_ends", "_local", "_i", "_left")


def signal_state_at(df: DataFrame, plans: DataFrame, t: str = "t", key: str = "id", group: str = "group") -> DataFrame:
    """Vehicle and pedestrian state of ``group`` at time ``t``, phase number and seconds left in it."""
    j = _timed(df, plans, t, key)
    return j.select(
        *df.columns, _now("groupStates", F.col(group)).alias("signal"), _now("pedStates", F.col(group)).alias("ped"),
        F.col("_i").alias("phase"), F.col("_left").alias("sec_left"),
    )


def _change(group: Column) -> Column:
    """Seconds until the group's vehicle state differs, looking round the cycle, to 0.1 s."""
    cur = _now("groupStates", group)
    n = F.size("phases")

    def look(acc: Column, i: Column) -> Column:
        ph = F.get("phases", (F.col("_i") + i) % n)
        done = acc["done"] | ~F.try_element_at(ph["groupStates"], group).eqNullSafe(cur)
        return F.struct(F.when(done, acc["rem"]).otherwise(acc["rem"] + ph["durSec"]).alias("rem"), done.alias("done"))

    start = F.struct(F.col("_left").alias("rem"), F.lit(False).alias("done"))
    rem = F.aggregate(F.sequence(F.lit(1), n), start, look)["rem"]
    return F.floor(rem * 10 + 0.5) / 10


def sec_to_change(df: DataFrame, plans: DataFrame, t: str = "t", key: str = "id", group: str = "group") -> DataFrame:
    return _timed(df, plans, t, key).withColumn("sec_to_change", _change(F.col(group))).select(*df.columns, "sec_to_change")


def leg_state(legs: DataFrame, plans: DataFrame, t: str = "t", overrides: DataFrame | None = None) -> DataFrame:
    """State of approach legs (id, leg_idx, control, group, ..., t).

    ``overrides`` (id, groupStates, pedStates) win over the plan; one with more than a
    single green is refused with an error.
    """
    j = _timed(legs, plans, t, "id")
    grp = F.col("group")
    veh, ped = _now("groupStates", grp), _now("pedStates", grp)
    if overrides is not None:
        greens = F.size(F.filter(F.map_values("groupStates"), lambda s: s == "green"))
        idle = F.create_map(F.lit("A"), F.lit("dont"), F.lit("B"), F.lit("dont"))
        checked = overrides.select(
            "id",
            F.when(greens > 1, F.raise_error(F.concat(F.lit("more than one green at "), F.col("id").cast("string")))).otherwise(
                F.col("groupStates")
            ).alias("_veh"),
            F.coalesce("pedStates", idle).alias("_ped"), F.lit(True).alias("_set"),
        )
        j = j.join(checked, "id", "left")
        veh = F.when(F.col("_set"), F.try_element_at("_veh", grp)).otherwise(veh)
        ped = F.when(F.col("_set"), F.try_element_at("_ped", grp)).otherwise(ped)
    signalled = (F.col("control") == "signal") & F.col("phases").isNotNull()
    j = j.withColumn("signal", F.when(signalled, veh)).withColumn("ped", F.when(signalled, ped))
    j = j.withColumn("sec_to_change", F.when(signalled, _change(grp)))
    go = F.when(F.col("control") == "signal", F.coalesce(F.col("signal") == "green", F.lit(False))).otherwise(F.col("control") == "uncontrolled")
    return j.withColumn("can_proceed", go).select(*legs.columns, "signal", "ped", "sec_to_change", "can_proceed")


def nearest_leg(df: DataFrame, legs: DataFrame, plans: DataFrame, left_id: str, t: str = "t", max_r: float = 60.0) -> DataFrame:
    """State of the nearest leg (stop point x, z; unique leg_key) within ``max_r`` of each row."""
    near = nearest_join(df, legs, left_id, "leg_key", max_dist=max_r, out="leg_key").where("leg_key is not null")
    info = legs.select("leg_key", "id", "leg_idx", "control", "group")
    return leg_state(near.join(info, "leg_key"), plans, t)


def signal_ahead(df: DataFrame, legs: DataFrame, plans: DataFrame, left_id: str, t: str = "t", max_dist: float = 22.0, lane: float = 4.0) -> DataFrame:
    """Distance and state of the stop line ahead; an unknown group reads red."""
    ahead = corridor_ahead(df, legs, left_id, "leg_key", max_dist, lane)
    info = legs.select(F.col("leg_key").alias("ahead_id"), "id", "group")
    out = signal_state_at(ahead.join(info, "ahead_id", "left"), plans, t)
    return out.select(*df.columns, "ahead_id", "ahead_dist", F.when(F.col("ahead_id").isNotNull(), F.coalesce("signal", F.lit("red"))).alias("ahead_signal"))
