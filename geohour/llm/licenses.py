"""Licence notices in texts: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geohour.llm.common import small
from geohour.llm.license_texts import TEMPLATES
from geohour.session import materialize

SHINGLE = 5
CONTAINMENT = 0.8
# One row per band. A window that holds a template with containment c has a Jaccard similarity
# of c / (2 + 1 - c) or more, as windows are twice as long as the template: 0.36 for c = 0.8.
# It shares a band with probability 1 - (1 - 0.36)^BANDS > 0.9999.
BANDS = 22
MISS = (1 - CONTAINMENT / (3 - CONTAINMENT)) ** BANDS


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits (and whatever is not ASCII)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words in order; fewer words, but not none, are one run."""

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
        return F.when(F.size(w) > 0, F.transform(
            F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " "))))

    # As a lambda's argument the words are split once, not once per run.
    return F.coalesce(F.transform(F.array(words), runs)[0], F.array().cast("array<bigint>"))


def _band(shingle: Column, band: Column) -> Column:
    return F.xxhash64(shingle, band)


def template_table(spark: SparkSession, templates: DataFrame | Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, number, own, n): the shingles of each template that has any.

    `templates` is a table with template and text, or rows of these two.
    """
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates), "template string, text string")
    own = rows.select("template", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("own")).distinct()
    return own.where(F.size("own") > 0).select(
        "template", F.xxhash64("template", "own").alias("number"), "own", F.size("own").alias("n"))


def band_table(table: DataFrame) -> DataFrame:
    """(shingle, number, n, band, lowest): a row per template and band.

    `lowest` is the template's MinHash in the band, which it attains at `shingle`.
    """
    bands = table.select("number", "own", "n", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    low = F.array_min(F.transform("own", lambda s: F.struct(_band(s, F.col("band")).alias("h"), s.alias("s"))))
    return bands.withColumn("low", low).select(F.col("low.s").alias("shingle"), "number", "n", "band", F.col("low.h").alias("lowest"))


def scan(docs: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, template, containment, first_window, n_windows): templates found in documents.

    A template of n shingles is looked for in windows of 2n shingles that begin every n
    shingles, so any stretch of n lies whole in one. A window is retrieved if its MinHash equals
    the template's in one of BANDS bands; equality needs the window to hold the shingle at which
    the template attains its minimum, so the bands are evaluated only where such a shingle
    occurs, which retrieves exactly the same windows. Retrieved windows are verified: at least
    CONTAINMENT of the template's shingles must be in the window. One row per document id and
    template, with the best containment, the number of the first verified window and how many
    there are.

    Shingles meet the bands as narrow rows, and only texts with a hit are opened again for their
    windows, so a list of templates of any length moves no text more than once. Whatever is small by
    a count of its bytes is broadcast; the rest is shuffled, with the same result.

    Null and empty texts match nothing; long texts are read whole; rows that repeat count as one;
    extra columns are not read; an empty table gives no rows; templates without words match
    nothing, and templates that repeat count once.
    """
    table = materialize(template_table(docs.sparkSession, templates), "licence-templates")
    bands = materialize(band_table(table), "licence-bands")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    places = texts.select("doc_id", "key", F.posexplode(shingles_of(words_of(F.col("text")))).alias("at", "shingle"))
    last = (F.col("at") / F.col("n")).cast("int")
    hits = places.join(small(bands), "shingle").withColumn(
        "window", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)))
    of_text = materialize(hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct(
        "number", "n", "band", "lowest", "window")).alias("hits")), "licence-hits")  # no more than its own shingles' bands
    asked = small(of_text.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "hits"))
    opened = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select(
        "doc_id", "hits", shingles_of(words_of(F.col("text"))).alias("all"))
    cut = opened.select("doc_id", "all", F.explode("hits").alias("hit")).select(
        "doc_id", "hit.*", F.slice("all", F.col("hit.window") * F.col("hit.n") + 1, 2 * F.col("hit.n")).alias("in_window"))
    same = cut.where(
        F.array_min(F.transform("in_window", lambda s: _band(s, F.col("band")))) == F.col("lowest")
    ).drop("n", "band", "lowest")
    shared = F.size(F.array_intersect("own", "in_window")) / F.col("n")
    return (
        same.join(small(table), "number")
        .withColumn("containment", shared).where(F.col("containment") >= CONTAINMENT)
        .groupBy("doc_id", "template", "window").agg(F.max("containment").alias("containment"))
        .groupBy("doc_id", "template").agg(
            F.max("containment").alias("containment"), F.min("window").cast("long").alias("first_window"),
            F.count("*").alias("n_windows"))
    )
