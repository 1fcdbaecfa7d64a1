"""Grid cells, names, tags, lookups and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .camera import finite

# ---- fixed values -----------------------------------------------------------
RAMP = (
    (38, 70, 120), (54, 110, 90), (96, 150, 70), (176, 190, 90),
    (206, 180, 120), (180, 140, 100), (200, 190, 175), (245, 245, 245),
)
CLASS_WIDTH = {
    "motorway": 15.0, "trunk": 14.0, "primary": 13.0, "secondary": 11.0, "tertiary": 9.0,
    "residential": 7.5, "unclassified": 7.5, "living_street": 6.5, "service": 5.5,
    "motorway_link": 7.0, "trunk_link": 7.0, "primary_link": 7.0,
    "secondary_link": 6.5, "tertiary_link": 6.5,
}
CITY_CLASS_WIDTH = {
    "motorway": 3.0, "trunk": 2.6, "primary": 2.2, "secondary": 1.8, "tertiary": 1.4,
    "residential": 1.0, "unclassified": 1.0, "living_street": 0.9, "motorway_link": 1.4,
    "trunk_link": 1.4, "primary_link": 1.2, "secondary_link": 1.1, "tertiary_link": 1.0,
}
CLASS_RANK = {
    "primary": 4, "primary_link": 4, "secondary": 3, "secondary_link": 3, "tertiary": 2,
    "tertiary_link": 2, "unclassified": 1, "residential": 1, "living_street": 1, "service": 0,
}
RANK_NAME = {4: "primary", 3: "secondary", 2: "tertiary", 1: "residential", 0: "service"}
ENUMS = {
    "vehicle_status": {0: "incoming_at", 1: "stopped_at", 2: "in_transit_to"},
    "occupancy": {
        0: "empty", 1: "many_seats", 2: "few_seats", 3: "standing_room",
        4: "crushed_standing", 5: "full", 6: "not_accepting",
    },
    "alert_cause": {
        1: "unknown", 2: "other", 3: "technical_problem", 4: "strike", 5: "demonstration",
        6: "accident", 7: "holiday", 8: "weather", 9: "maintenance", 10: "construction",
        11: "police_activity", 12: "medical_emergency",
    },
    "alert_effect": {
        1: "no_service", 2: "reduced_service", 3: "significant_delays", 4: "detour",
        5: "additional_service", 6: "modified_service", 7: "other", 8: "unknown",
        9: "stop_moved", 10: "no_effect", 11: "accessibility_issue",
    },
}
VEHICLE_DIMS = {
    # type: length, width, height (m), colour
    "car": (4.5, 1.9, 1.45, 0x3577C9), "truck": (8.0, 2.5, 3.0, 0x8E6BD0),
    "bus": (12.0, 2.9, 3.3, 0xE0A83A), "moto": (2.2, 0.9, 1.3, 0xC77F2A),
    "bike": (1.8, 0.6, 1.2, 0x4AA05A), "ped": (0.6, 0.6, 1.7, 0xE25FAE),
    "robot": (0.8, 0.6, 0.6, 0x4AA05A), "drone": (0.9, 0.9, 0.35, 0x9B59B6),
}
CLASS_TYPE = {0: "ped", 1: "bike", 2: "car", 3: "moto", 5: "bus", 7: "truck"}
INSTRUCTIONS = ("drive to {name}", "navigate to {name}", "go to {name}", "head over to {name}")
LEVEL_HEIGHT_M = 3.5
TILE_MIN_X, TILE_MIN_Y, TILE_STEP_X, TILE_STEP_Y = -91525.0, -170396.5, 2600.0, 2640.0
TILE_EAST0, TILE_EAST_STEP, TILE_NORTH0, TILE_NORTH_STEP = 15626, 26, 185064, 2640
CONTROL_RANGE = {
    "throttle": (0.0, 1.0), "brake": (0.0, 1.0), "steer": (-1.0, 1.0), "left": (-1.0, 1.0),
    "right": (-1.0, 1.0), "thrust": (0.0, 1.0), "climb": (-1.0, 1.0),
}


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, NULL for unknown keys."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


# ---- grids ------------------------------------------------------------------
def grid_cell(
    x: Column, z: Column, cell: float, x0: float = 0.0, z0: float = 0.0, mode: str = "floor",
    nx: int | None = None, nz: int | None = None,
) -> tuple[Column, Column]:
    """Cell indices.  ``floor`` and ``trunc`` differ below the origin; ``clamp``
    truncates and then pulls outside points onto the border cells."""
    fx, fz = (x - F.lit(x0)) / F.lit(cell), (z - F.lit(z0)) / F.lit(cell)
    if mode == "floor":
        return F.floor(fx).cast("long"), F.floor(fz).cast("long")
    ix, iz = fx.cast("long"), fz.cast("long")
    if mode == "trunc":
        return ix, iz
    lo = F.lit(0).cast("long")
    return F.greatest(F.least(ix, F.lit(nx - 1)), lo), F.greatest(F.least(iz, F.lit(nz - 1)), lo)


def weld_key(x: Column, z: Column, cell: float = 4.0) -> tuple[Column, Column]:
    """Half-to-even rounding, so a point midway between two cells goes to the even one."""
    return F.bround(x / F.lit(cell)).cast("long"), F.bround(z / F.lit(cell)).cast("long")


def hypsometric_rgb(y: Column, lo: float = 235.0, hi: float = 315.0) -> tuple[Column, Column, Column]:
    """Elevation colour: position on an eight-stop ramp, mixed linearly, cut to bytes."""
    t = F.least(F.greatest((y - F.lit(lo)) / F.lit(max(hi - lo, 1e-6)), F.lit(0.0)), F.lit(1.0)) * 7
    i = F.least(F.floor(t), F.lit(6)).cast("int")
    f = t - i
    out = []
    for ch in range(3):
        stops = F.array(*[F.lit(float(s[ch])) for s in RAMP])
        out.append((F.get(stops, i) * (1 - f) + F.get(stops, i + 1) * f).cast("int"))
    return tuple(out)


def height_ratio(df: DataFrame, col: str, out: str = "ratio") -> DataFrame:
    """(h - min) / (max - min); a flat column has range 1."""
    from ..plans.onerow import beside

    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return (
        beside(df, ends)
        .withColumn(out, (F.col(col) - F.col("_lo")) / span)
        .drop("_lo", "_hi")
    )


# ---- names ------------------------------------------------------------------
def tile_name(ux_cm: Column, uy_cm: Column) -> Column:
    e = F.floor((ux_cm - F.lit(TILE_MIN_X)) / F.lit(TILE_STEP_X)).cast("long")
    n = F.floor((uy_cm - F.lit(TILE_MIN_Y)) / F.lit(TILE_STEP_Y)).cast("long")
    return F.format_string(
        "B-%dE-%dN", e * TILE_EAST_STEP + TILE_EAST0, n * TILE_NORTH_STEP + TILE_NORTH0
    )


def sequence_name(df: DataFrame, base: str, order: list[str], block: Column, out: str = "name") -> DataFrame:
    """Base name plus a running number, three digits at least, in the given order."""
    from ..plans.ordered import running_total

    numbered = running_total(df.withColumn("_one", F.lit(1)), [base], order, {"_rn": "_one"}, block)
    rn = F.col("_rn").cast("string")
    digits = F.when(F.length(rn) < 3, F.lpad(rn, 3, "0")).otherwise(rn)
    return numbered.withColumn(out, F.concat_ws("-", F.col(base), digits)).drop("_one", "_rn")


def tag_height(tags: Column) -> Column:
    """Metres from ``height`` (first token), else from ``building:levels``; NULL if unreadable."""
    h, lv = tags["height"], tags["building:levels"]
    first = F.split(F.trim(h), r"\s+")[0]
    return F.when(h.isNotNull(), first.try_cast("double")).otherwise(lv.try_cast("double") * LEVEL_HEIGHT_M)


def class_width(c: Column) -> Column:
    return F.coalesce(lookup(c, CLASS_WIDTH), F.lit(7.0))


def class_rank(c: Column) -> Column:
    return F.coalesce(lookup(c, CLASS_RANK), F.lit(1))


def rank_name(r: Column) -> Column:
    return F.coalesce(lookup(r, RANK_NAME), F.lit("residential"))


def decode_enum(c: Column, table: str) -> Column:
    return lookup(c.cast("int"), ENUMS[table])


def vehicle_dims(df: DataFrame, cls: str) -> DataFrame:
    """Add type, body size and colour of a detector class (unknown = car)."""
    kind = F.coalesce(lookup(F.col(cls).cast("int"), CLASS_TYPE), F.lit("car"))
    df = df.withColumn("type", kind)
    for i, name in enumerate(("length_m", "width_m", "height_m", "color")):
        df = df.withColumn(name, lookup(F.col("type"), {k: v[i] for k, v in VEHICLE_DIMS.items()}))
    return df


# ---- text -------------------------------------------------------------------
def translated_text(translations: Column, lang: str = "en") -> Column:
    """First text in the language (a missing language counts as English), else the first text."""
    hits = F.filter(translations, lambda t: F.coalesce(F.nullif(t["Language"], F.lit("")), F.lit("en")).startswith(lang))
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["Text"]).otherwise(F.get(translations, F.lit(0))["Text"])


def pick_phase(df: DataFrame, phases: tuple[str, ...] = ("phase3", "phase2", "phase1")) -> DataFrame:
    """Add url, year and phase of the newest phase with a usable link."""
    options = []
    for p in phases:
        url = F.col(f"{p}_aws_url")
        usable = url.isNotNull() & (url != "") & (url != "None")
        options.append(F.when(usable, F.struct(url.alias("url"), F.col(f"{p}_year").alias("year"), F.lit(p).alias("phase"))))
    return df.withColumn("_p", F.coalesce(*options)).select("*", "_p.url", "_p.year", "_p.phase").drop("_p")


def clean_text(c: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def sort_order(c: Column, missing: int = 9999) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(F.lit(missing))


def rewrite_query_param(url: Column, key: str, value: str) -> Column:
    """Replace a ``WxH`` value of a query parameter."""
    return F.regexp_replace(url, rf"(?i)([?&]{key}=)\d+x\d+", "$1" + value.replace("$", r"\$"))


def cache_signature(url: Column, drop: tuple[str, ...] = ("key", "session")) -> Column:
    """sha1 of the path and the sorted query without the named parameters."""
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    parts = F.filter(
        F.split(query, "&"),
        lambda kv: kv.contains("=") & ~kv.endswith("=") & ~F.split(kv, "=")[0].isin(*drop),
    )
    keyed = F.array_sort(F.transform(parts, lambda kv, i: F.struct(F.split(kv, "=")[0].alias("k"), i.alias("i"), kv.alias("kv"))))
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    return F.sha1(F.concat(path, F.lit("?"), F.array_join(F.transform(keyed, lambda s: s["kv"]), "&")))


def hash_offset(key: Column, modulo: Column) -> Column:
    """md5 read as one big integer, modulo a cycle length (at least 1)."""
    m = F.greatest(modulo.cast("long"), F.lit(1).cast("long"))
    words = F.sequence(F.lit(1), F.lit(29), F.lit(4))
    digest = F.md5(key)
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda acc, i: F.pmod(acc * 65536 + F.conv(F.substr(digest, i, F.lit(4)), 16, 10).cast("long"), m),
    )


def hash_hue(s: Column) -> Column:
    """32-bit polynomial string hash (base 31) modulo 360."""
    text = F.coalesce(F.nullif(s, F.lit("")), F.lit("0"))
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(4294967296)))
    return h % 360


def clamp_controls(df: DataFrame) -> DataFrame:
    """Clamp each control column that is present; non-finite values become NULL."""
    for name, (lo, hi) in CONTROL_RANGE.items():
        if name in df.columns:
            v = F.col(name).try_cast("double")
            df = df.withColumn(name, F.when(finite(v), F.least(F.greatest(v, F.lit(lo)), F.lit(hi))))
    if "yawRate" in df.columns:
        v = F.col("yawRate").try_cast("double")
        df = df.withColumn("yawRate", F.when(finite(v), v))
    return df


def eta_seconds(arrival: Column, now: Column) -> Column:
    return arrival - now


def eta_minutes(arrival: Column, now: Column) -> Column:
    """Nearest minute, halves upwards."""
    return F.floor((arrival - now) / 60 + 0.5).cast("long")


def instruction_text(df: DataFrame, seed: int | None = None, out: str = "instruction") -> DataFrame:
    """Sentence for a named place; stops are called "the ... stop".  With a seed the
    wording is drawn by a hash of the name, without one the first wording is used."""
    name = F.when(
        (F.col("kind") == "stop") & ~F.lower("name").contains("stop"), F.format_string("the %s stop", "name")
    ).otherwise(F.col("name"))
    heads = F.array(*[F.lit(t.replace("{name}", "")) for t in INSTRUCTIONS])
    pick = F.lit(0) if seed is None else F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(len(INSTRUCTIONS))).cast("int")
    return df.withColumn(out, F.concat(F.get(heads, pick), name))


def numeric_aware_key(c: Column) -> tuple[Column, Column]:
    """Sort columns for "Bus 9" before "Bus 10": text before the number, then the number."""
    return F.lower(F.regexp_extract(c, r"^([^0-9]*)", 1)), F.regexp_extract(c, r"([0-9]+)", 1).try_cast("long")
