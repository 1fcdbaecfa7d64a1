"""Deterministic spatial views over the driver tables, in SQL common to Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # name: (source table, SQL); {t} stands for the source table
    "fx_points": ("lineitem", """
        SELECT CAST((l_partkey*37 + l_orderkey*13) % 10007 AS DOUBLE)/10 AS x,
               CAST((l_suppkey*101 + l_orderkey*7 + l_linenumber*997) % 10007 AS DOUBLE)/10 AS z,
               240 + l_quantity*2 AS y,
               CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 6 END AS cls,
               l_orderkey*10 + l_linenumber AS pid, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {t}"""),
    "fx_boxes": ("part", """
        SELECT p_partkey AS box_id, p_name AS name, CAST((p_partkey*7919) % 10007 AS DOUBLE)/10 AS cx,
               CAST((p_partkey*104729) % 10007 AS DOUBLE)/10 AS cz, 2 + p_size*0.25E0 AS half,
               CASE WHEN p_partkey % 3 = 0 THEN 4 + p_size*0.5E0 END AS tag_h FROM {t}"""),
    "fx_sites": ("customer", """
        SELECT c_custkey AS site_id, CAST((c_custkey*7907) % 10007 AS DOUBLE)/10 AS x,
               CAST((c_custkey*15485863) % 10007 AS DOUBLE)/10 AS z, c_acctbal, c_nationkey FROM {t}"""),
    "fx_targets": ("supplier", """
        SELECT s_suppkey AS target_id, CAST((s_suppkey*6151) % 10007 AS DOUBLE)/10 AS x,
               CAST((s_suppkey*49157) % 10007 AS DOUBLE)/10 AS z, s_nationkey FROM {t}"""),
    "fx_poses": ("events", """
        SELECT event_id, user_id AS track_id, ts, event_type, value,
               CAST((event_id*7919 + user_id*31) % 2003 AS DOUBLE)/10 AS x,
               CAST((event_id*104729 + user_id*17) % 2003 AS DOUBLE)/10 AS z,
               CAST((event_id*37) % 628 AS DOUBLE)/100 AS yaw FROM {t}"""),
    "fx_vertices": ("orders", """
        SELECT o_custkey AS road_id, o_orderkey AS seq, CAST((o_orderkey*7919) % 10007 AS DOUBLE)/10 AS x,
               CAST((o_orderkey*104729) % 10007 AS DOUBLE)/10 AS z, o_orderpriority AS class FROM {t}"""),
    # short roads of sixteen vertices, each within a 40 m square
    "fx_roads": ("orders", """
        SELECT CAST(floor(o_orderkey/16.0E0) AS BIGINT) AS road_id, o_orderkey % 16 AS seq,
               CAST((CAST(floor(o_orderkey/16.0E0) AS BIGINT)*7919) % 10007 AS DOUBLE)/10 + CAST((o_orderkey*7919 + (o_orderkey % 1009)*(o_orderkey % 1009)) % 401 AS DOUBLE)/10 AS x,
               CAST((CAST(floor(o_orderkey/16.0E0) AS BIGINT)*104729) % 10007 AS DOUBLE)/10 + CAST((o_orderkey*104729 + (o_orderkey % 1013)*(o_orderkey % 1013)) % 401 AS DOUBLE)/10 AS z,
               CAST(o_totalprice AS DOUBLE)/10000 AS y, o_orderkey,
               CASE CAST(floor(o_orderkey/16.0E0) AS BIGINT) % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary'
                    WHEN 2 THEN 'tertiary' WHEN 3 THEN 'residential' ELSE 'service' END AS class,
               concat('Street ', CAST(CAST(floor(o_orderkey/16.0E0) AS BIGINT) % 97 AS VARCHAR(20))) AS name FROM {t}"""),
    "fx_detections": ("events", """
        SELECT user_id % 8 AS camera, CAST(floor(event_id / 40) AS BIGINT) AS frame, event_id % 4 AS quad, event_id AS det_id,
               CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 7 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 0 END AS cls,
               CAST((event_id*7919) % 401 AS DOUBLE)/10 AS x, CAST((event_id*104729) % 401 AS DOUBLE)/10 AS z,
               CAST((event_id*7919) % 1009 AS DOUBLE)/1009 AS u, CAST((event_id*104729) % 1013 AS DOUBLE)/1013 AS v, ts FROM {t}"""),
}


class Tables:
    """Driver tables and fixture views of one data directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            path = f"{self.dir}/{name}.parquet"
            df = self.spark.read.parquet(path)
            for col, kind in df.dtypes:
                if kind == "timestamp_ntz":
                    df = df.withColumn(col, df[col].cast("timestamp"))
            return df
        source, sql = VIEWS["fx_" + name]
        return self.spark.sql(sql.format(t="{t}"), t=getattr(self, source))


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views for an engine that has the tables."""
    parts = []
    for n in names:
        source, sql = VIEWS["fx_" + n]
        parts.append(f"fx_{n} AS ({sql.format(t=source)})")
    return "WITH " + ",\n".join(parts)
