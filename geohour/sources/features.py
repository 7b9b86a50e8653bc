"""GeoJSON features in and out, and tables of many files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geohour.operators.shapes import LINES_TYPE, PARTS_TYPE, POINT
from geohour.session import materialize
from geohour.sources import json_scan
from geohour.sources.storage import path_exists

_POSITION = "array<double>"


def _point(p: Column) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def _line(points: Column) -> Column:
    return F.transform(points, _point)


def _lines(lines: Column) -> Column:
    return F.transform(lines, _line)


def _is_feature(text: Column) -> Column:
    kind = F.call_function("try_variant_get", F.try_parse_json(text), F.lit("$.type"), F.lit("string"))
    return F.coalesce(kind == "Feature", F.lit(False))


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, sound): one row per feature of collections, of single features, and of lines.

    Features are found by the structure of the document (`json_scan`), so members may come in
    any order, strings may hold anything, and a file may be one line or printed over many, of
    any size. Files with a feature per line are sequences of documents; a broken line does not
    hide the next ones. Text that belongs to no feature makes a row that is not sound instead of
    vanishing.

    The spans are stored in the shared folder, as several steps read them: features that lie in
    one split are taken as they are, only those between two splits meet by their number. A
    document that does not end, or is none, is not put together but looked at line by line, so a
    broken line early in a large file gathers nothing.
    """
    text, key = F.col("text").cast("string"), ["file", "kind", "number"]
    found = materialize(json_scan.spans(spark, path, "features").withColumn("text", text), "json-spans")
    whole = (F.col("kind") == "element") & F.col("starts") & F.col("ends")
    shared = found.where(~whole & (F.col("kind") != "between"))
    facts = shared.groupBy(*key).agg(F.bool_or("holds").alias("collection"), F.bool_or("ends").alias("ended"))
    shared = shared.join(facts, key)
    joined = (
        shared.where("ended AND NOT collection").groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("block", "n", "text"))).alias("pieces"))
        .select("file", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
        .withColumn("sound", _is_feature(F.col("text")))
    )
    loose = found.where("kind = 'between'").select("file", "text").unionByName(
        shared.where("NOT ended").select("file", "text")).unionByName(joined.where("NOT sound").select("file", "text"))
    lines = loose.select("file", F.explode(F.split("text", "\n")).alias("text")).where(r"text RLIKE '\\S'")
    return (
        found.where(whole).select("file", "text").unionByName(lines).withColumn("sound", _is_feature(F.col("text")))
        .unionByName(joined.where("sound"))
    )


def _rejected(texts: DataFrame) -> DataFrame:
    return texts.where("NOT sound").select("file", F.btrim("text", F.lit(" \t\r\n")).alias("text"))


def rejected_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what `read_geojson` cannot read."""
    return _rejected(feature_texts(spark, path))


def read_geojson(spark: SparkSession, path: str, properties: str, skip_broken: bool = False) -> DataFrame:
    """Features of GeoJSON files: collections, single features, or one feature per line.

    `properties` is the schema of the properties as DDL. Adds `geom_type`, `lines` (for lines
    and points: an array of vertex arrays) and `parts` (for polygons: parts of rings of
    vertices). Coordinates nest to different depths by type, so each type is cast on its own.
    Text that is no feature is an error here; with `skip_broken` it is left to
    `rejected_features`.
    """
    texts = feature_texts(spark, path)
    if not skip_broken:
        broken = _rejected(texts).first()
        if broken is not None:
            raise ValueError(f"no feature in {broken.file}: {broken.text[:200]}")
    return _decode(texts.where("sound").select(F.try_parse_json("text").alias("f")), properties)


read_feature_lines = read_geojson


def _decode(features: DataFrame, properties: str) -> DataFrame:
    kind = F.expr("try_variant_get(f, '$.geometry.type', 'string')")

    def coords(depth: int) -> Column:
        nested = "array<" * depth + _POSITION + ">" * depth
        return F.expr(f"try_variant_get(f, '$.geometry.coordinates', '{nested}')")

    lines = (
        F.when(kind == "Point", F.array(F.array(_point(coords(0)))))
        .when(kind == "LineString", F.array(_line(coords(1))))
        .when(kind == "MultiLineString", _lines(coords(2)))
    )
    parts = (
        F.when(kind == "Polygon", F.array(_lines(coords(2))))
        .when(kind == "MultiPolygon", F.transform(coords(3), _lines))
    )
    props = F.from_json(F.to_json(F.expr("try_variant_get(f, '$.properties', 'variant')")),
                        properties)
    return features.select(
        kind.alias("geom_type"),
        lines.cast(LINES_TYPE).alias("lines"),
        parts.cast(PARTS_TYPE).alias("parts"),
        props.alias("_props"),
    ).select("geom_type", "lines", "parts", "_props.*")


def square_feature(x: Column, y: Column, step: float) -> Column:
    """Geometry of a square cell from its lower-left corner."""
    corners = F.array(*[
        F.array(x + F.lit(i * step), y + F.lit(j * step))
        for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    ])
    return F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))


def write_geojson(df: DataFrame, geometry: Column, properties: list[str], path: str) -> None:
    """One feature per line, so that the result is split between tasks on both ways."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        geometry.alias("geometry"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("errorifexists").text(path)


def union_files(tables: list[DataFrame]) -> DataFrame:
    """Many tables as one, with the union of their columns."""
    if not tables:
        raise ValueError("no table to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_years(spark: SparkSession, pattern: str, years: range, reader) -> DataFrame:
    """Union of the yearly files that exist; `pattern` holds {year}."""
    paths = [pattern.format(year=y) for y in years]
    return union_files([reader(p) for p in paths if path_exists(spark, p)])


__all__ = [
    "POINT", "read_geojson", "read_feature_lines", "square_feature", "write_geojson",
    "union_files", "read_years",
]
