"""Observed properties, lane rules, speeds, time buckets and text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property names under which providers store speeds and confidence, in order of preference.
CURRENT_SPEED_KEYS = (
    "traffic_level", "trafficLevel", "trafficlevel", "currentSpeed", "current_speed", "cs",
    "cspd", "cSpeed", "speed", "sp", "s", "c",
)
FREEFLOW_SPEED_KEYS = (
    "freeFlowSpeed", "freeflowSpeed", "freeflow_speed", "ffs", "ffSpeed", "ff", "f", "free",
)
CONFIDENCE_KEYS = ("confidence", "cn", "conf")
ID_KEYS = ("id", "segmentId", "segment_id", "uuid")

# Defaults for absent attributes.
DEFAULT_CONFIDENCE = 0.9
DEFAULT_LANE_SPEED = 13.89
DEFAULT_FREEFLOW_KMH = 50.0
NO_DATA_SPEED = "-1.00"

MAX_MATCH_DISTANCE = 100.0


def first_prop_double(props: Column, keys: tuple[str, ...]) -> Column:
    """First listed property that reads as a number."""
    return F.coalesce(*[props.getItem(k).try_cast("double") for k in keys])


def segment_id_from_props(props: Column, layer: Column, geometry: Column) -> Column:
    """First non-empty id property, else the layer name and a hash of the geometry."""
    known = [F.when(~props.getItem(k).isin("", "0"), props.getItem(k)) for k in ID_KEYS]
    return F.coalesce(*known, F.concat(layer, F.lit("_"), F.sha1(F.to_json(geometry))))


def parse_shape(shape: Column) -> Column:
    """``"x,y x,y"`` to an array of ``struct<x, y>``; null for fewer than two points."""
    points = F.transform(
        F.split(F.trim(shape), r"\s+"),
        lambda p: F.struct(
            F.split(p, ",")[0].try_cast("double").alias("x"),
            F.try_element_at(F.split(p, ","), F.lit(2)).try_cast("double").alias("y"),
        ),
    )
    return F.when(F.size(points) >= 2, points)


def vclass_allowed(allow: Column, disallow: Column, vclass: str = "passenger") -> Column:
    """An allow list decides alone; else a disallow list; else everything may pass."""
    allow, disallow = F.coalesce(allow, F.lit("")), F.coalesce(disallow, F.lit(""))
    return (
        F.when(allow != "", F.array_contains(F.split(allow, r"\s+"), vclass))
        .when(disallow != "", ~F.array_contains(F.split(disallow, r"\s+"), vclass))
        .otherwise(True)
    )


def match_confidence(distance: Column, max_distance: float = MAX_MATCH_DISTANCE) -> Column:
    """1 at distance 0 falling to 0 at the limit; null beyond it."""
    return F.when(distance <= max_distance, F.greatest(F.lit(0.0), F.lit(1.0) - distance / max_distance))


def edge_weight(priority: Column, speed: Column, lanes: Column) -> Column:
    return (
        F.greatest(F.lit(1), F.coalesce(priority, F.lit(1)))
        * F.greatest(F.lit(5.0), F.coalesce(speed, F.lit(DEFAULT_LANE_SPEED)))
        * F.greatest(F.lit(1), F.coalesce(lanes, F.lit(1)))
    )


def speed_kmh(speed_text: Column) -> Column:
    """Metres per second as text to km/h; null for the no-data mark."""
    return F.when(~speed_text.isin("", NO_DATA_SPEED), speed_text.try_cast("double") * 3.6)


def has_speed(speed_text: Column) -> Column:
    return F.coalesce(~speed_text.isin("", NO_DATA_SPEED), F.lit(False))


def time_bucket(ts: Column, minutes: int = 5) -> Column:
    """``struct<start, label>`` of the bucket that holds the timestamp."""
    width = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / width) * width)
    return F.struct(start.alias("start"), F.date_format(start, "yyyy-MM-dd'T'HH:mm").alias("label"))


def departure_time(start: Column, end: Column, count: Column, k: Column) -> Column:
    """Departure ``k`` of ``count`` evenly spaced over (start, end]; the last one is exactly the end."""
    start, end = start.cast("double"), end.cast("double")
    step = (end - start) / count
    return F.when((end <= start) | (k == count), end).otherwise(start + step * k)


def departure_times(start: Column, end: Column, count: Column) -> Column:
    """All departures of one bin as an array; empty for a count of zero or less."""
    ks = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(ks, lambda k: departure_time(start, end, count, k))


def format_departure(value: Column) -> Column:
    """Six decimals without trailing zeros."""
    text = F.format_string("%.6f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def gene_to_count(value: Column) -> Column:
    """Half-even rounding, never negative."""
    return F.greatest(F.lit(0), F.bround(value.cast("double"), 0).cast("long"))


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(int(default)).cast("bigint"))


def as_bool(value: Column, default: bool) -> Column:
    # Accepted words.
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isin("1", "true", "yes", "on"), True)
        .when(word.isin("0", "false", "no", "off"), False)
        .otherwise(bool(default))
    )


def valid_dataset_name(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def parse_bbox(text: Column) -> Column:
    """``"w,s,e,n"`` to a box struct; null unless it holds exactly four numbers."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when(
        (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()),
        F.struct(
            F.get(parts, F.lit(0)).alias("west"), F.get(parts, F.lit(1)).alias("south"),
            F.get(parts, F.lit(2)).alias("east"), F.get(parts, F.lit(3)).alias("north"),
        ),
    )


def log_level(line: Column) -> Column:
    return (
        F.when(line.contains(" - INFO - "), "info")
        .when(line.contains(" - WARNING - "), "warning")
        .when(line.contains(" - ERROR - "), "error")
    )


def log_message(line: Column) -> Column:
    """Text after the third separator, without surrounding white space."""
    return F.regexp_replace(F.element_at(F.split(line, " - ", 4), -1), r"^\s+|\s+$", "")
