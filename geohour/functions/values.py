"""Number, identifier and text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geohour.functions.temporal import col

# Distance classes, right-closed.
DISTANCE_EDGES = (-1.0, 100.0, 500.0)
DISTANCE_LABELS = ("0-100m", "100-500m", "500m+")

# Words after which a sensor address turns into a description.
LANDMARK_WORDS = (
    "앞", "옆", "뒤", "사거리", "교차로", "맨홀", "측구", "지점에 위치", "도로에 위치",
)


def safe_cast(c: Column | str, to: str) -> Column:
    """NULL instead of an error for text that is no number; NaN counts as missing too."""
    value = col(c).try_cast(to)
    if to in ("float", "double"):
        return F.when(~F.isnan(value), value)
    return value


def normalize_id(c: Column | str) -> Column:
    return F.trim(col(c).cast("string"))


def distance_class(d: Column | str) -> Column:
    """0 for (-1, 100], 1 for (100, 500], 2 beyond; NULL outside or missing."""
    d = col(d)
    low, first, second = DISTANCE_EDGES
    return F.when(d > second, 2).when(d > first, 1).when(d > low, 0).cast("int")


def distance_label(d: Column | str) -> Column:
    cls = distance_class(d)
    near, mid, far = DISTANCE_LABELS
    return F.when(cls == 0, near).when(cls == 1, mid).when(cls == 2, far)


def contains_text(c: Column | str, part: str) -> Column:
    """Substring test in which a missing value does not match."""
    return F.coalesce(F.contains(col(c).cast("string"), F.lit(part)), F.lit(False))


def clean_address(c: Column | str, landmarks: tuple[str, ...] = LANDMARK_WORDS) -> Column:
    """Geocodable head of an address text; empty text where there is none."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    # Entities first: an escaped tag is a tag.
    text = F.regexp_replace(text, r"<.*?>", "")
    text = F.regexp_replace(text, r"\(.*?\)", "")
    text = F.regexp_replace(text, "(?s)(" + "|".join(landmarks) + ").*$", "")
    text = F.substring_index(text, ",", 1)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    missing = F.lower(F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " "))) == "none"
    return F.when(missing, F.lit("")).otherwise(text)
