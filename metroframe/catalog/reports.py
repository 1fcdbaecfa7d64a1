"""Episode, reward, policy and observation analytics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import with_views
from ..operators import metrics as M
from ..operators import spatial as D
from .registry import query, r


def steps(t):
    """Conversations as episodes: a turn is a step, the text length its reward."""
    c = t.conversations
    return c.select(F.col("conv_id").alias("episode"), F.col("turn").alias("step"), (F.length("text") / 100.0).alias("reward"), "role")


def episodes(t):
    e = F.col("conv_id")
    heads = t.conversations.select("conv_id").distinct()
    return heads.select(
        e.alias("episode"), (e % 3 != 0).alias("success"), (50.0 + e % 17).alias("optimal"), (45.0 + e % 29).alias("path_len"),
        (e % 7 == 0).alias("crashed"), (e % 11 == 0).alias("offmap"), F.when(e % 2 == 0, "campus_easy").otherwise("drone_survey").alias("scenario"),
    )


_EP = """ep AS (SELECT conv_id AS episode, sum(length(text)/100.0E0) AS ret, count(*) AS steps, conv_id % 3 <> 0 AS success, 50.0E0 + conv_id % 17 AS optimal, 45.0E0 + conv_id % 29 AS path_len, conv_id % 7 = 0 AS crashed, conv_id % 11 = 0 AS offmap,
 CASE WHEN conv_id % 2 = 0 THEN 'campus_easy' ELSE 'drone_survey' END AS scenario FROM conversations GROUP BY conv_id), er AS (SELECT *, CASE WHEN success THEN optimal/greatest(path_len, optimal, 1e-6) ELSE 0 END AS spl FROM ep)"""


@query(f"WITH {_EP} SELECT scenario, count(*) AS episodes, round(avg(CAST(success AS INTEGER)),6)+0.0 AS success_rate, round(avg(spl),6)+0.0 AS spl, round(avg(CAST(crashed AS INTEGER)),6)+0.0 AS collision_rate, round(avg(CAST(offmap AS INTEGER)),6)+0.0 AS offmap_rate, round(avg(ret),4)+0.0 AS mean_return, round(avg(steps),6)+0.0 AS mean_steps FROM er GROUP BY scenario")
def episode_metrics(t):
    """Success, SPL, collision and return per scenario."""
    out = M.episode_metrics(M.episode_rows(steps(t), episodes(t)), ["scenario"])
    cols = ["success_rate", "spl", "collision_rate", "offmap_rate", "mean_steps"]
    return out.select("scenario", "episodes", *[r(c).alias(c) for c in cols], r("mean_return", 4).alias("mean_return"))


@query("SELECT conv_id AS episode, round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END),6)+0.0 AS on_road_frac, round(avg(CASE WHEN turn % 5 = 0 THEN 1.0 ELSE 0.0 END),6)+0.0 AS crash_frac, round(count(*)*0.1E0,6)+0.0 AS sim_s FROM conversations GROUP BY conv_id")
def route_fractions(t):
    s = steps(t).withColumn("on_road", F.col("role") == "user").withColumn("crashed", F.col("step") % 5 == 0)
    out = M.route_fractions(s)
    return out.select("episode", *[r(c).alias(c) for c in ("on_road_frac", "crash_frac", "sim_s")])


def _sim(t):
    i = F.col("event_id")
    return t.events.select(
        "event_id", (F.col("value") + 1).alias("prev_dist"), F.when(i % 4 != 0, F.col("value")).alias("dist"), (i % 25).cast("double").alias("speed"),
        (F.col("value") < 8).alias("reached"), (i % 9 == 0).alias("crashed"), (i % 31 == 0).alias("offmap"), (i % 3 != 0).alias("on_road"), (F.col("value") / 10).alias("progress"),
    )


@query("SELECT event_id, round(-0.01 + CASE WHEN event_id % 4 <> 0 THEN 2.0*((value+1)-value) + CASE WHEN value < 8 THEN 10 ELSE 0 END ELSE 0.05*(event_id % 25) END + CASE WHEN event_id % 9 = 0 THEN -5 ELSE 0 END + CASE WHEN event_id % 31 = 0 THEN -5 ELSE 0 END,6)+0.0 AS reward_sum FROM events")
def reward_terms(t):
    """Named reward terms with one weight overridden."""
    return M.reward_terms(_sim(t), {"progress": 2.0}).select("event_id", r("reward_sum").alias("reward_sum"))


@query("SELECT event_id, round(-0.02 + value/10 + 0.03*(event_id % 25) + CASE WHEN event_id % 3 <> 0 THEN 0.15 ELSE -0.6 END + CASE WHEN event_id % 25 < 0.5 THEN -0.4 ELSE 0 END + CASE WHEN event_id % 9 = 0 THEN -2 ELSE 0 END + CASE WHEN value < 8 THEN 200 ELSE 0 END + CASE WHEN event_id % 31 = 0 THEN -40 ELSE 0 END,6)+0.0 AS reward_sum FROM events")
def route_reward_terms(t):
    return M.route_reward_terms(_sim(t)).select("event_id", r("reward_sum").alias("reward_sum"))


@query(with_views("poses") + " SELECT event_id, 0.5E0 AS throttle, round(least(greatest(-1.5*atan2(z, abs(x)+1e-3), -1), 1),6)+0.0 AS steer FROM fx_poses")
def score_rows(t):
    """A user policy scored over observation rows."""

    def policy(obs: pd.DataFrame) -> pd.DataFrame:
        return M.greedy_policy(obs).assign(event_id=obs["event_id"].to_numpy())[["event_id", "throttle", "steer"]]

    obs = t.poses.select("event_id", F.col("x").alias("goal_fwd"), F.col("z").alias("goal_lat"))
    return M.score_rows(obs, policy, "event_id bigint, throttle double, steer double").withColumn("steer", r("steer"))


@query(with_views("poses") + " SELECT event_id, CASE WHEN value < 20 THEN 1.0E0 ELSE 0.0E0 END AS brake, round(value/100,6)+0.0 AS throttle FROM fx_poses")
def apply_controller(t):
    """A user controller from sensors to controls."""

    def brake_near(s: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"brake": (s["value"] < 20).astype(float), "throttle": s["value"] / 100})

    out = M.apply_controller(t.poses.select("event_id", "value"), brake_near, ["value"], "brake double, throttle double")
    return out.select("event_id", "controls.brake", r("controls.throttle").alias("throttle"))


@query(with_views("poses", "targets") + """, n AS (SELECT event_id, arg_min({'x': t.x/5, 'z': t.z/5}, {'d': (p.x-t.x/5)*(p.x-t.x/5)+(p.z-t.z/5)*(p.z-t.z/5), 'i': t.target_id}) AS o FROM fx_poses p, fx_targets t GROUP BY event_id)
 SELECT event_id, round(value/25,6)+0.0 AS o0, round(cos(yaw),6)+0.0 AS o3, round(((o.x-x)*cos(yaw)-(o.z-z)*sin(yaw))/60,6)+0.0 AS o7, round(sqrt((o.x-x)*(o.x-x)+(o.z-z)*(o.z-z))/60,6)+0.0 AS o9, round(sqrt((100-x)*(100-x)+(100-z)*(100-z))/200,6)+0.0 AS o12, 0.0E0 AS o15, 1.0E0 AS o16, 18 AS n FROM fx_poses JOIN n USING (event_id)""")
def ego_features(t):
    """Eighteen-value observations: nearest box, goal, others and signal in the ego frame."""
    boxes = t.targets.select("target_id", (F.col("x") / 5).alias("x"), (F.col("z") / 5).alias("z"))
    near = D.nearest_join(t.poses, boxes, "event_id", "target_id").drop("dist")
    at = boxes.select(F.col("target_id").alias("nearest_id"), F.col("x").alias("box_x"), F.col("z").alias("box_z"))
    none = F.lit(None).cast("double")
    p = near.join(at, "nearest_id", "left").select(
        "event_id", "x", "z", "yaw", F.col("value").alias("speed"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vz"), none.alias("agl"), F.lit(False).alias("contact"),
        "box_x", "box_z", F.lit(100.0).alias("goal_x"), F.lit(100.0).alias("goal_z"), none.alias("other_x"), none.alias("other_z"), none.alias("sig_dist"), F.lit(None).cast("string").alias("sig_state"),
    )
    o = F.col("obs")
    return M.ego_features(p).select("event_id", *[r(o[i]).alias(f"o{i}") for i in (0, 3, 7, 9, 12, 15, 16)], F.size(o).alias("n"))


@query(f"WITH {_EP} SELECT episode, scenario, CASE scenario WHEN 'campus_easy' THEN 'car' ELSE 'drone' END AS agent_type, CASE scenario WHEN 'campus_easy' THEN 1000 ELSE 1500 END AS max_steps FROM ep")
def with_scenarios(t):
    """Episodes with the parameters of their scenario."""
    return M.with_scenarios(episodes(t), M.scenarios(t.spark)).select("episode", "scenario", "agent_type", "max_steps")


@query("SELECT p_name AS name, CASE WHEN min(CASE WHEN p_size <= 10 THEN 0 ELSE 1 END) = 0 THEN 'stop' ELSE 'street' END AS kind FROM part WHERE p_name <> '' GROUP BY p_name")
def named_places(t):
    """Stops and streets with unique names, stops first."""
    p = t.part.select("p_size", F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_partkey").cast("double").alias("x"), F.lit(0.0).alias("z"))
    return M.named_places(p.where("p_size <= 10"), p).select("name", "kind")
