"""File readers and writers.

Binary files are read by byte ranges (``records``); writers keep files near a million points.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rasters import chunk_manifest
from ..plans.ordered import row_numbers, running_total
from . import records, schemas

def _records(spark: SparkSession, kind: str, path: str, split: int | None, **options) -> DataFrame:
    records.register(spark)
    reader = spark.read.format(f"metroframe_{kind}").options(**options)
    return (reader if split is None else reader.option("split", split)).load(path)


def _write_records(df: DataFrame, kind: str, path: str, order: Sequence[str], most: int) -> DataFrame:
    """Rows by chunk to ``path``; returns file and count."""
    spark = df.sparkSession
    records.register(spark)
    laid = df.repartition("chunk").sortWithinPartitions("chunk", *order).drop(*order)
    laid.write.format(f"metroframe_{kind}").option("records", most).mode("append").save(path)
    return spark.read.schema("file string, count bigint").json(f"{path}/files.json")


# ---- point clouds --------------------------------------------------------------
def read_point_chunks(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Point chunks: a count and 16-byte records, read in ranges of ``split`` bytes.  A truncated file is an error."""
    return _records(spark, "points", path, split)


def write_point_chunks(df: DataFrame, path: str, tile: str = "tile") -> DataFrame:
    """Points as Parquet partitioned by tile; returns the manifest (count and bounds per tile).

    Large tiles go to several tasks and files, a million rows or so each.
    """
    spread = df.repartition(tile, F.pmod(F.xxhash64("x", "y", "z"), F.lit(8)))
    spread.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy(tile).parquet(path)
    return chunk_manifest(df.sparkSession.read.parquet(path), tile)


def write_point_bins(df: DataFrame, path: str, chunk: str = "chunk", most: int = records.FILE_RECORDS) -> DataFrame:
    """The binary form, one file per chunk (bounded by ``grid_chunk``); returns file and count.

    A chunk of more than ``most`` points goes on in further files.  Missing colours are 255.  Only files of committed
    tasks get their final names; ``path`` should be new, and must be shared by the cluster.
    """
    cols = [F.col(c).cast("float") if c in df.columns else F.lit(255.0).cast("float").alias(c) for c in "xyz"]
    cols += [F.col(c).cast("short") if c in df.columns else F.lit(255).cast("short").alias(c) for c in "rgba"]
    return _write_records(df.select(F.col(chunk).cast("long").alias("chunk"), *cols), "points", path, [], most)


# ---- meshes and rings ------------------------------------------------------------
def read_mesh_vertices(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Vertex positions of mesh files: path, i, x, y, z.  Texture coordinates are not read."""
    return _records(spark, "vertices", path, split)


def write_mesh_vertices(df: DataFrame, path: str, chunk: str = "chunk", order: str = "i") -> DataFrame:
    """One mesh file of positions per chunk, in the order of ``order``; returns file and count.

    A mesh is one file by its format, and its positions are held by the task that writes it.
    """
    cols = [F.col(c).cast("float") for c in "xyz"]
    return _write_records(df.select(F.col(chunk).cast("long").alias("chunk"), F.col(order).alias("_i"), *cols), "vertices", path, ["_i"], 1 << 31)


def read_footprint_bins(spark: SparkSession, path: str, origin_cm: tuple[float, float, float], split: int | None = None) -> DataFrame:
    """Base ring of extruded building files, in scene metres.  Short files are left out."""
    from ..functions.rings import ring_area

    rings = _records(spark, "rings", path, split, origin_x=origin_cm[0], origin_y=origin_cm[1])
    return rings.where(ring_area(F.col("ring")) > 0)


# ---- grids ---------------------------------------------------------------------
def write_grid(cells: DataFrame, spec: dict, path: str) -> None:
    cells.select("ix", "iz", "y").write.mode("overwrite").parquet(f"{path}/cells")
    spark = cells.sparkSession
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    return spark.read.parquet(f"{path}/cells"), spec


def read_dense_grid(spark: SparkSession, path: str, spec: dict, split: int | None = None) -> DataFrame:
    """Row-major float32 raster to sparse cells; NaN gaps become missing rows."""
    return _records(spark, "cells", path, split, nx=spec["nx"], nz=spec["nz"])


# ---- documents -----------------------------------------------------------------
def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def split_osm(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``e`` (one map element each) to nodes, ways and relations."""
    nodes = elements.where("e.type = 'node'").select("e.id", "e.lon", "e.lat")
    ways = elements.where("e.type = 'way'").select(F.col("e.id").alias("way_id"), "e.nodes", "e.tags")
    relations = elements.where("e.type = 'relation'").select(F.col("e.id").alias("rel_id"), "e.members", "e.tags")
    return nodes, ways, relations


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Map extract documents: (nodes, ways, relations)."""
    return split_osm(_document(spark, path, schemas.OSM).select(F.explode("elements").alias("e")))


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five schedule tables as text columns; a missing file is an empty table."""
    out = {}
    for table, cols in schemas.GTFS.items():
        try:
            raw = spark.read.option("header", True).csv(f"{path}/{table}.txt")
        except AnalysisException:
            out[table] = spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))
            continue
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
        out[table] = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in cols])
    return out


def gtfs_routes(routes: DataFrame) -> DataFrame:
    from ..functions.scalars import clean_text, sort_order

    return routes.select(
        "route_id", clean_text(F.col("route_short_name")).alias("short_name"), clean_text(F.col("route_long_name")).alias("long_name"),
        clean_text(F.col("route_color"), "3b82c4").alias("color"), clean_text(F.col("route_text_color"), "FFFFFF").alias("text_color"),
        sort_order(F.col("route_sort_order")).alias("sort_order"),
    )


def gtfs_stops(stops: DataFrame) -> DataFrame:
    """Boardable stops with readable coordinates."""
    from ..functions.predicates import boardable

    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    return stops.where(boardable(F.col("location_type")) & lat.isNotNull() & lon.isNotNull()).select(
        "stop_id", F.coalesce(F.trim("stop_code"), F.lit("")).alias("code"), F.coalesce(F.trim("stop_name"), F.lit("")).alias("name"),
        lat.alias("lat"), lon.alias("lon"),
    )


def gtfs_shapes(shapes: DataFrame) -> DataFrame:
    seq = F.col("shape_pt_sequence").try_cast("int")
    lat, lon = F.col("shape_pt_lat").try_cast("double"), F.col("shape_pt_lon").try_cast("double")
    return shapes.select("shape_id", seq.alias("seq"), lon.alias("lon"), lat.alias("lat")).where(
        "seq is not null and lon is not null and lat is not null"
    )


def read_gtfs_rt(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Realtime feed documents (vehicles, trips, alerts) as rows: feed_ts, e.  Batch or stream."""
    reader = (spark.readStream if stream else spark.read).schema(schemas.feed(kind)).option("multiLine", True)
    return reader.json(path).select(F.col("Header.Timestamp").alias("feed_ts"), F.explode("Entities").alias("e"))


def extract_js_array(df: DataFrame, html: str, name: str, element: str) -> DataFrame:
    """Rows of a JavaScript array literal embedded in HTML: one ``e`` per element.

    Quotes are swapped to double; the parser reads exactly one array from the first
    bracket after the name, so brackets inside strings and trailing text do no harm.
    """
    text = F.translate(F.col(html), "'", '"')
    tail = F.when(F.locate(name, text) > 0, F.substr(text, F.locate(name, text)))
    literal = F.when(F.locate("[", tail) > 0, F.substr(tail, F.locate("[", tail)))
    parsed = F.from_json(literal, f"ARRAY<{element}>")
    return df.withColumn("e", F.explode(parsed))


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features: lon, lat, properties.  Other geometries are left out."""
    f = _document(spark, path, schemas.GEOJSON).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    c = F.from_json("f.geometry.coordinates", "ARRAY<DOUBLE>")
    return f.select(c[0].alias("lon"), c[1].alias("lat"), F.col("f.properties").alias("properties"))


def read_layer_json(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One row per record of a layer, from files of one document each or of one document per line.

    A file in which some line is no document of its own is one document.
    """
    doc = f"{layer} ARRAY<{schemas.LAYERS[layer]}>"
    place = F.col("_metadata.file_path").alias("_file")
    lines = spark.read.schema(f"{doc}, _broken STRING").option("columnNameOfCorruptRecord", "_broken").json(path).select(layer, "_broken", place)
    whole = lines.where(F.col("_broken").isNotNull() & F.col(layer).isNull()).select("_file").distinct()
    documents = spark.read.schema(doc).option("multiLine", True).json(path).select(layer, place).join(whole, "_file", "left_semi")
    rows = lines.where("_broken is null").select(layer, "_file").join(whole, "_file", "left_anti").unionByName(documents)
    return rows.select(F.explode(layer).alias("r")).select("r.*")


def write_layer_json(df: DataFrame, path: str, layer: str) -> None:
    """A layer as JSON documents, one record each, so that nothing is gathered in one task."""
    df.select(F.array(F.struct(*df.columns)).alias(layer)).write.mode("overwrite").json(path)


def read_layer_lines(spark: SparkSession, path: str, layer: str) -> DataFrame:
    doc = f"{layer} ARRAY<{schemas.LAYERS[layer]}>"
    return spark.read.schema(doc).json(path).select(F.explode(layer).alias("r")).select("r.*")


# ---- logs, calibration -----------------------------------------------------------
def read_episode_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSONL episode logs, one file each: (episodes, steps with their 0-based ``step``)."""
    lines = spark.read.schema(schemas.EPISODE).json(path).select(
        F.col("_metadata.file_path").alias("episode"), F.col("_metadata.file_block_start").alias("_off"), "*",
        F.monotonically_increasing_id().alias("_row"),
    )
    episodes = lines.where("meta is not null").select("episode", "meta.*")
    steps = lines.where("meta is null")
    numbered = row_numbers(steps, ["episode"], ["_off", "_row"], F.col("_off"), "_n")
    return episodes, numbered.select("episode", (F.col("_n") - 1).alias("step"), "action", "reward", "terminated", "truncated")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return explode_calibration(_document(spark, path, schemas.CALIBRATION))


def explode_calibration(doc: DataFrame) -> DataFrame:
    """camera, intersection, quad, h, points, reproj of the quads with a full matrix."""
    cams = doc.select(F.explode("cameras").alias("camera", "c"))
    quads = cams.select("camera", F.col("c.intersection").alias("intersection"), F.explode("c.quads").alias("quad", "q"))
    return quads.where(F.size("q.H") == 9).select(
        "camera", "intersection", F.col("quad").cast("int").alias("quad"), F.col("q.H").alias("h"), "q.points",
        F.col("q.reprojError").alias("reproj"),
    )


def upsert_calibration(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the entries of ``new`` by (camera, quad) and keep the rest."""
    from ..operators.sets import upsert

    return upsert(existing, new, ["camera", "quad"])


# ---- manifests -------------------------------------------------------------------
def pack_with_offsets(df: DataFrame, order_by: Sequence[str], block: Column, counts: Sequence[str] = ("vertex_count", "index_count")) -> DataFrame:
    """Start offsets of concatenated parts: ``<count>_start`` is the sum of all earlier counts.

    ``block`` must not fall along ``order_by``.
    """
    return running_total(df, [], list(order_by), {f"{c}_start": c for c in counts}, block, exclusive=True)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return normalize_manifest(_document(spark, path, schemas.MANIFEST))


def normalize_manifest(doc: DataFrame) -> dict[str, DataFrame]:
    """Tiles, chunks, buildings and origin with aliases and defaults resolved."""
    zero = F.array(*[F.lit(0.0)] * 3)
    t = doc.select(F.posexplode(F.coalesce("terrain.tiles", "tiles")).alias("i", "t"))
    t = t.withColumn("name", F.coalesce("t.name", F.concat(F.lit("tile_"), F.col("i").cast("string"))))
    shift = F.coalesce("t.translation_cm", "t.translationCm", zero)
    tiles = t.select(
        "i", "name",
        F.coalesce("t.mesh", "t.mesh_bin", "t.bin", F.format_string("meshes/%s.bin", "name")).alias("mesh"),
        F.coalesce("t.texture", "t.jpg", "t.image", F.format_string("textures/%s.jpg", "name")).alias("texture"),
        shift.alias("translation_cm"), F.coalesce("t.rotation_deg", "t.rotation_pyr_deg", zero).alias("rotation_deg"),
        F.coalesce("t.scale", F.array(*[F.lit(1.0)] * 3)).alias("scale"), F.coalesce("t.visible", F.lit(True)).alias("visible"),
    )
    c = doc.select(F.posexplode("lidar.chunks").alias("i", "c"))
    default_file = F.format_string("lidar/chunk_%03d.bin", F.col("i"))
    chunks = c.select(
        "i", F.coalesce("c.file", "c.path", "c.url", default_file).alias("file"), F.coalesce("c.count", "c.points").alias("count")
    )
    b = doc.select(F.explode("buildings.tiles").alias("b"))

    def either(x: str, y: str, default: Column | None = None) -> Column:
        return F.coalesce(f"b.{x}", f"b.{y}", *([default] if default is not None else [])).alias(x)

    buildings = b.select(
        "b.name", "b.file", either("bounds_min_cm", "boundsMinCm"), either("bounds_max_cm", "boundsMaxCm"),
        either("height_cm", "heightCm", F.lit(0.0)), either("footprint_area_m2", "footprintAreaM2", F.lit(0.0)),
        either("point_count", "pointCount", F.lit(0)), either("vertex_count", "vertexCount", F.lit(0)),
        either("index_count", "indexCount", F.lit(0)), either("ground_y_m", "groundYm"),
        F.coalesce("b.bridge", F.lit(False)).alias("bridge"),
    )
    all_tiles = F.coalesce("terrain.tiles", "tiles")
    first = F.get(all_tiles, F.lit(0))
    origin = doc.select(
        F.coalesce(
            "origin_cm", "originCm", "lidar.offset_cm", "lidar.offsetCm", first["translation_cm"], first["translationCm"], zero
        ).alias("origin_cm")
    )
    return {"tiles": tiles, "chunks": chunks, "buildings": buildings, "origin": origin}


def merge_manifests(mesh: DataFrame, scene: DataFrame) -> DataFrame:
    """Terrain tiles present in both tables (by name) with file names and placement defaults."""
    j = mesh.select("name").join(scene, "name")
    have = scene.columns

    def opt(c: str, default: Column) -> Column:
        return (F.coalesce(F.col(c), default) if c in have else default).alias(c)

    zero, one = F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(1.0)] * 3)
    return j.select(
        "name", F.format_string("meshes/%s.bin", "name").alias("mesh"), F.format_string("textures/%s.jpg", "name").alias("texture"),
        opt("translation_cm", zero), opt("rotation_deg", zero), opt("scale", one), opt("visible", F.lit(True)),
    )


def verify_layer(df: DataFrame, files: DataFrame | None, required: Sequence[str], file_col: str = "file", name: str = "name") -> DataFrame:
    """Problems of a layer: name, issue.  ``files`` lists the files that exist (column ``file``)."""
    gaps = [F.when(F.col(c).isNull(), F.concat(F.lit("missing field: "), F.lit(c))) for c in required]
    found = df.select(name, F.explode(F.filter(F.array(*gaps), lambda g: g.isNotNull())).alias("issue"))
    if files is None:
        return found
    have = files.select(F.col("file").alias(file_col)).distinct()
    lost = df.where(F.col(file_col).isNotNull()).join(have, file_col, "left_anti")
    return found.unionByName(lost.select(name, F.concat(F.lit("missing file: "), F.col(file_col)).alias("issue")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of files under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
