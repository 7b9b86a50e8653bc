"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geohour.llm.common import free_name, lower_ascii, small
from geohour.session import materialize

WINDOW = 10
ANCHORS = 2  # rarest terms of a window whose posting lists are intersected
# Characters outside words, once A-Z are lower case.
_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words in order; none for null. Two equal texts have equal words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _OUTSIDE), lambda w: w != "")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item, items_words, first, size): the windows of each benchmark item.

    A window is WINDOW consecutive words; an item of fewer words, but not none, is one window.
    `item` numbers the text, so that items of one id but different texts stay apart.
    """
    w = words_of(F.col(text))
    base = items.select(F.col(item_id).alias("item_id"), w.alias("item_words")).distinct()
    size = F.least(F.size("item_words"), F.lit(WINDOW))
    return (
        base.where(F.size("item_words") > 0)
        .withColumn("item", F.xxhash64("item_id", "item_words"))
        .withColumn("size", size)
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("size"))))
    )


def _anchors(windows: DataFrame, counts: DataFrame, anchors: int) -> DataFrame:
    """The `anchors` rarest positions of each window, those of windows that can occur at all.

    Returns (item, first, size, term, at, lead): `at` counts from the item's start, `lead` marks
    the rarest position of the window.
    """
    terms = windows.select(
        "item", "first", "size", F.posexplode(F.slice("item_words", F.col("first") + 1, F.col("size")))
        .alias("k", "term"),
    ).join(counts, "term", "left")
    ranked = terms.groupBy("item", "first", "size").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "k"))),
                1, anchors).alias("rarest"),  # a window has WINDOW terms at most
    ).where("least > 0")
    return ranked.select("item", "first", "size", F.posexplode("rarest").alias("rank", "r")).select(
        "item", "first", "size", F.col("r.term").alias("term"), (F.col("first") + F.col("r.k")).alias("at"),
        (F.col("rank") == 0).alias("lead"))


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text",
                around: int = WINDOW - 1) -> DataFrame:
    """Postings (term, doc_id, text_key, pos, left, near) of the terms in `terms`, stored.

    `terms` has term and lead. For lead terms, the rarest ones, `near` holds the words from
    `around` before to `around` after the position and `left` how many of them come before it:
    whoever reads such a posting can confirm a phrase without the text.

    Words meet the terms where the text is read while the terms can be broadcast. More terms are
    joined by a shuffle of (term, document, position), and only documents with lead terms are
    opened again for the words near them.
    """
    key = ["doc_id", "text_key"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_key(F.col(text)).alias("text_key"),
                       words_of(F.col(text)).alias("words"))
    left = F.least(F.col("pos"), F.lit(around)).alias("left")
    near = F.array_join(F.slice("words", F.col("pos") - F.least(F.col("pos"), F.lit(around)) + 1,
                                F.least(F.col("pos"), F.lit(around)) + 1 + around), " ")
    chosen = small(terms)
    if chosen is not terms:
        return materialize(
            rows.select(*key, "words", F.posexplode("words").alias("pos", "term")).join(chosen, "term")
            .select("term", *key, "pos", left, F.when(F.col("lead"), near).alias("near")), "postings")
    found = materialize(
        rows.select(*key, F.posexplode("words").alias("pos", "term")).join(terms, "term"), "found-terms")
    lead = found.where("lead").groupBy(*key).agg(
        F.collect_list(F.struct("pos", "term")).alias("at"))  # at most a document's words
    again = rows.alias("d").join(
        lead.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.text_key") == F.col("l.text_key"))
    ).select("d.doc_id", "d.text_key", "words", F.explode("at").alias("p")).select(
        *key, "words", F.col("p.pos").alias("pos"), F.col("p.term").alias("term"))
    return materialize(
        again.select("term", *key, "pos", left, near.alias("near")).unionByName(
            found.where("NOT lead").select("term", *key, "pos", left, F.lit(None).cast("string").alias("near"))),
        "postings")


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how often each of `terms` occurs in all documents."""
    return (
        docs.select(F.explode(words_of(F.col(text))).alias("term")).join(small(terms), "term")
        .groupBy("term").agg(F.count("*").alias("n"))
    )


def matches(docs: DataFrame, items: DataFrame, slop: int = 0, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, text_key, item_id, item, first, pos, size, exact) of windows found in documents.

    Training counts say which terms of each window are rare; only those get postings. Each
    posting names, for each window that its term anchors, the position at which that window
    would have to begin. Where all of a window's anchors name one beginning, the posting lists
    intersect, and the words stored with a posting confirm the phrase (`exact`). With `slop`
    over 0, windows whose anchors all lie within that many words of their places are returned
    too, with exact = false (proximity matches; words between may differ).
    """
    windows = materialize(item_windows(items), "windows")
    vocabulary = materialize(
        windows.select(F.explode("item_words").alias("term")).distinct(), "test-terms")
    counts = materialize(term_counts(docs, vocabulary), "term-counts")
    wanted = materialize(_anchors(windows, counts, anchors), "anchors")
    index = build_index(
        docs, materialize(wanted.groupBy("term").agg(F.max("lead").alias("lead")), "anchor-terms"))
    places = wanted.select("item", "term", "at").distinct()
    # One row per posting and place in an item; all windows of the item share the alignment.
    hit = index.join(places, "term").select(
        "doc_id", "text_key", "item", "at", (F.col("pos") - F.col("at")).alias("shift"), "left", "near")
    if slop:
        steps = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
        hit = hit.withColumn("moved", steps).withColumn("shift", F.col("shift") + F.col("moved"))
    else:
        hit = hit.withColumn("moved", F.lit(0))
    need = wanted.groupBy("item", "first", "size").agg(
        F.collect_set("at").alias("ats"))  # `anchors` places at most
    aligned = hit.groupBy("doc_id", "text_key", "item", "shift").agg(
        F.collect_set("at").alias("seen"),  # places of one item at most
        F.collect_set(F.when((F.col("moved") == 0) & F.col("near").isNotNull(), F.struct("at", "left", "near"))).alias("views"))
    found = aligned.join(need, "item").where(
        F.size(F.array_intersect("seen", "ats")) == F.size("ats"))
    texts = windows.select(
        "item", "item_id", "first",
        F.array_join(F.slice("item_words", F.col("first") + 1, F.col("size")), " ").alias("phrase"))

    def confirms(view: Column) -> Column:
        skip = view["left"] - (view["at"] - F.col("first"))
        return (F.array_contains(F.col("ats"), view["at"]) & (skip >= 0)
                & (F.array_join(F.slice(F.split(view["near"], " "), skip + 1, F.col("size")), " ")
                   == F.col("phrase")))

    got = found.join(texts, ["item", "first"]).withColumn(
        "exact", F.exists("views", lambda v: F.when(
            v["left"] >= v["at"] - F.col("first"), confirms(v)).otherwise(False)))
    return got.where("exact" if not slop else "true").select(
        "doc_id", "text_key", "item_id", "item", "first", (F.col("shift") + F.col("first")).alias("pos"),
        "size", "exact")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an exact occurrence of a window of any item; n_items counts the
    item ids with such windows, items_sha256 digests them sorted as strings and comma-joined.
    Null and empty texts have no words and are clean. Rows that repeat are all returned, each
    with the figures of its own text. Items without words match nothing; a null item id counts
    its words as hit but is no item. An empty table of items leaves every document clean.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    found = materialize(matches(base.select("doc_id", "text"), items), "matches")
    key = ["doc_id", "text_key"]
    hit = (
        found.select(*key, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("word"))
        .distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    )
    ids = found.select(*key, F.col("item_id").cast("string").alias("id")).distinct().groupBy(*key).agg(
        F.count("id").alias("n_items"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    marks = hit.join(ids, (hit.doc_id.eqNullSafe(ids.doc_id)) & (hit.text_key == ids.text_key)).select(
        hit.doc_id.alias("d"), hit.text_key.alias("t"), "n_hit", "n_items", "ids")
    rows = base.withColumn("text_key", _text_key(F.col("text"))).withColumn(
        "n_words", F.size(words_of(F.col("text"))).cast("long"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(marks, rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("t")), "left").select(
        rows.doc_id, "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *keep)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` of which no word is hit, with their columns; see `contamination`."""
    d, t = free_name(docs, "__doc"), free_name(docs, "__key")
    found = materialize(matches(docs.select("doc_id", "text"), items).select(
        F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct(), "contaminated")
    return docs.join(
        found, docs["doc_id"].eqNullSafe(found[d]) & (_text_key(docs["text"]) == found[t]), "left_anti")
