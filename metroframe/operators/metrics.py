"""Episode, reward and observation analytics over logged rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import ego_frame

# Default term weights, normalisers and named scenarios: fixed values.
REWARD_WEIGHTS = {"progress": 1.0, "goal_bonus": 10.0, "collision": -5.0, "offmap": -5.0, "time": -0.01, "speed": 0.05}
ROUTE_WEIGHTS = {
    "progress": 1.0, "goal_bonus": 200.0, "on_road": 0.15, "off_road": -0.6, "speed": 0.03, "stall": -0.4,
    "collision": -2.0, "collision_terminal": -60.0, "offmap": -40.0, "time": -0.02,
}
OBS_RANGE, GOAL_RANGE, VEH_RANGE, SIG_RANGE, AGL_RANGE = 60.0, 200.0, 40.0, 25.0, 50.0
SCENARIOS = (
    # name, agent_type, goal, half size of the region, other vehicles, signals, randomised, step limit
    ("campus_easy", "car", "random", 150.0, 0, False, False, 1000),
    ("campus_traffic", "car", "random", 150.0, 14, True, False, 1000),
    ("delivery_named", "truck", "named", 200.0, 10, True, True, 1500),
    ("robot_courier", "robot", "named", 200.0, 8, True, False, 1500),
    ("drone_survey", "drone", "named", 200.0, 0, False, False, 1500),
)


def spl(success: Column, optimal: Column, path: Column) -> Column:
    """Success weighted by path length."""
    return F.when(success, optimal / F.greatest(path, optimal, F.lit(1e-6))).otherwise(0.0)


def episode_rows(steps: DataFrame, episodes: DataFrame, key: str = "episode") -> DataFrame:
    """One row per episode: return and steps from the log, flags and SPL from its header."""
    sums = steps.groupBy(key).agg(F.sum("reward").alias("ret"), F.count(F.lit(1)).alias("steps"))
    return episodes.join(sums, key).withColumn("spl", spl(F.col("success"), F.col("optimal"), F.col("path_len")))


def episode_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success, SPL, collision and off-map rates, mean return and steps."""

    def rate(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), rate("success").alias("success_rate"), F.avg("spl").alias("spl"),
        rate("crashed").alias("collision_rate"), rate("offmap").alias("offmap_rate"),
        F.avg("ret").alias("mean_return"), F.avg("steps").alias("mean_steps"),
    )


def route_fractions(steps: DataFrame, key: str = "episode", dt: float = 0.1) -> DataFrame:
    """Share of steps on the road and in a crash, and the time used."""
    return steps.groupBy(key).agg(
        F.avg(F.col("on_road").cast("double")).alias("on_road_frac"), F.avg(F.col("crashed").cast("double")).alias("crash_frac"),
        (F.count(F.lit(1)) * dt).alias("sim_s"),
    )


def reward_terms(steps: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Named reward terms and their sum.

    steps: prev_dist, dist (NULL without a goal), speed, reached, crashed, offmap.
    Adds ``terms MAP<STRING, DOUBLE>`` (only terms that apply) and ``reward_sum``.
    """
    w = {**REWARD_WEIGHTS, **(weights or {})}
    goal = F.col("dist").isNotNull()

    def term(name: str, applies: Column, value: Column | float) -> Column:
        v = value if isinstance(value, Column) else F.lit(float(value))
        return F.struct(F.lit(name).alias("key"), F.when(applies, v).alias("value"))

    yes = F.lit(True)
    parts = [
        term("time", yes, w["time"]),
        term("progress", goal, w["progress"] * (F.col("prev_dist") - F.col("dist"))),
        term("goal_bonus", goal & F.col("reached"), w["goal_bonus"]),
        term("speed", ~goal, w["speed"] * F.col("speed")),
        term("collision", F.col("crashed"), w["collision"]),
        term("offmap", F.col("offmap"), w["offmap"]),
    ]
    return _summed(steps, parts)


def route_reward_terms(steps: DataFrame, weights: dict[str, float] | None = None, stall_speed: float = 0.5, strict: bool = False) -> DataFrame:
    """Reward terms of route following: progress, speed, on_road, reached, crashed, offmap.

    ``strict`` uses the terminal collision weight.
    """
    w = {**ROUTE_WEIGHTS, **(weights or {})}

    def term(name: str, applies: Column, value: Column | float) -> Column:
        v = value if isinstance(value, Column) else F.lit(float(value))
        return F.struct(F.lit(name).alias("key"), F.when(applies, v).alias("value"))

    yes = F.lit(True)
    parts = [
        term("time", yes, w["time"]),
        term("progress", yes, w["progress"] * F.col("progress")),
        term("speed", yes, w["speed"] * F.col("speed")),
        term("on_road", F.col("on_road"), w["on_road"]),
        term("off_road", ~F.col("on_road"), w["off_road"]),
        term("stall", F.col("speed") < stall_speed, w["stall"]),
        term("collision", F.col("crashed"), w["collision_terminal" if strict else "collision"]),
        term("goal_bonus", F.col("reached"), w["goal_bonus"]),
        term("offmap", F.col("offmap"), w["offmap"]),
    ]
    return _summed(steps, parts)


def _summed(steps: DataFrame, parts: list[Column]) -> DataFrame:
    terms = F.map_from_entries(F.filter(F.array(*parts), lambda t: t["value"].isNotNull()))
    out = steps.withColumn("terms", terms)
    return out.withColumn("reward_sum", F.aggregate(F.map_values("terms"), F.lit(0.0), lambda a, v: a + v))


def score_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user policy to observation rows in Arrow batches (logged rows, no rollout)."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def apply_controller(df: DataFrame, fn: Callable[..., pd.DataFrame], inputs: Sequence[str], controls: str) -> DataFrame:
    """Add ``controls``, a struct a user function computes from sensor columns in Arrow batches."""

    @F.pandas_udf(controls)
    def run(sensors: pd.DataFrame) -> pd.DataFrame:
        return fn(sensors)

    return df.withColumn("controls", run(F.struct(*inputs)))


def ego_features(poses: DataFrame, max_speed: float = 25.0) -> DataFrame:
    """The 18-value observation of each pose row, as ``obs ARRAY<DOUBLE>``.

    Takes the results of the joins: speed, vx, vz, yaw, agl, contact; nearest box
    (box_x, box_z), goal (goal_x, goal_z), nearest other vehicle (other_x, other_z)
    and the signal ahead (sig_dist, sig_state).  Missing neighbours read 0, a clear
    signal 1 and 0.
    """
    yaw, ms = F.col("yaw"), F.lit(max(max_speed, 1e-3))
    fwd, lat = ego_frame(F.col("vx"), F.col("vz"), yaw)

    def offset(px: str, pz: str, scale: float) -> list[Column]:
        dx, dz = F.col(px) - F.col("x"), F.col(pz) - F.col("z")
        f, s = ego_frame(dx, dz, yaw)
        return [F.coalesce(v / scale, F.lit(0.0)) for v in (f, s, F.hypot(dx, dz))]

    red = F.coalesce(F.col("sig_state").isin("red", "yellow").cast("double"), F.lit(0.0))
    obs = [
        F.col("speed") / ms, fwd / ms, lat / ms, F.cos(yaw), F.sin(yaw), F.coalesce(F.col("agl"), F.lit(0.0)) / AGL_RANGE,
        F.col("contact").cast("double"), *offset("box_x", "box_z", OBS_RANGE), *offset("goal_x", "goal_z", GOAL_RANGE),
        *offset("other_x", "other_z", VEH_RANGE), F.coalesce(F.col("sig_dist") / SIG_RANGE, F.lit(1.0)), red,
    ]
    return poses.withColumn("obs", F.array(*obs))


def scenarios(spark) -> DataFrame:
    """The named scenario records as a table."""
    return spark.createDataFrame(
        list(SCENARIOS),
        "scenario string, agent_type string, goal string, half double, others int, signals boolean, randomised boolean, max_steps int",
    )


def with_scenarios(runs: DataFrame, table: DataFrame) -> DataFrame:
    """Runs with the parameters of their scenario; unknown names keep NULLs."""
    return runs.join(table, "scenario", "left")


def greedy_policy(obs: pd.DataFrame) -> pd.DataFrame:
    """Example policy: steer at the goal.  Input goal_fwd, goal_lat; output throttle, steer."""
    turn = [math.atan2(s, abs(f) + 1e-3) for f, s in zip(obs["goal_fwd"], obs["goal_lat"])]
    return pd.DataFrame({"throttle": 0.5, "steer": [max(-1.0, min(1.0, -1.5 * t)) for t in turn]})


def named_places(stops: DataFrame, streets: DataFrame) -> DataFrame:
    """Stops, then longest streets, with clean unique names: name, kind, x, z."""
    from .sets import union_keep_first

    def tidy(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.trim("name").alias("name"), F.lit(kind).alias("kind"), "x", "z").where("name != ''")

    return union_keep_first([tidy(stops, "stop"), tidy(streets, "street")], ["name"], ["x", "z"])
