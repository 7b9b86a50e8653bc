"""Order MinHash: fingerprints of texts that are sensitive to edit distance, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from geohour.session import materialize

SHINGLE = 5  # units of a k-mer
TUPLE = 2  # k-mers that make one entry
ENTRIES = 64  # entries of a fingerprint
# A unit is a run of characters between blanks; a character of a script that sets no blanks
# between words is a unit of its own.
_UNSPACED = (r"[฀-໿က-႟ក-៿⺀-꓏豈-﫿\x{20000}-\x{3FFFF}]")
_BLANKS, _BREAKS = r"\s++", rf"\s++|(?={_UNSPACED})|(?<={_UNSPACED})"


def _bind(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def kmers(text: Column) -> Column:
    """Hashes of the k-mers of units in text order; fewer units, but not none, are one k-mer."""
    # Both patterns cut a text without such scripts alike; the shorter one is faster.
    unspaced = (F.octet_length(text) > F.char_length(text)) & text.rlike(_UNSPACED)
    cut = F.when(unspaced, F.split(text, _BREAKS)).otherwise(F.split(text, _BLANKS))

    def hashes(parts: Column) -> Column:
        named = F.transform(parts, lambda u: F.xxhash64(u))
        # an empty part, before a leading blank, say, is no unit
        units = F.when(F.array_contains(parts, ""), F.filter(named, lambda h: h != F.xxhash64(F.lit("")))).otherwise(named)
        return _bind(units, joined)

    def joined(units: Column) -> Column:
        last = F.greatest(F.size(units) - SHINGLE, F.lit(0))
        return F.when(F.size(units) > 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(SHINGLE)])))

    return F.coalesce(_bind(cut, hashes), F.array().cast("array<bigint>"))


def _place_bits(hashes: Column) -> Column:
    """Bits that hold each place of an array, counted from 1."""
    return F.length(F.bin(F.size(hashes).cast("long")))


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _place(packed: Column, bits: Column) -> Column:
    return packed.bitwiseAND(_left(F.lit(1).cast("long"), bits) - 1)


def _packed(key: Column, place: Column, bits: Column) -> Column:
    """The upper bits of a key with the place, from 1, in the lower ones: such numbers sort by key, then place."""
    return _left(_right(key, bits), bits).bitwiseOR(place.cast("long"))


def occurrences(hashes: Column, bits: Column) -> Column:
    """The keys of occurrence-numbered k-mers in order, packed with their places.

    Sorted with their places, equal k-mers lie side by side in text order, and each run numbers
    its members. The first keeps its hash as key, so the firsts stay in order; a further
    occurrence gets the hash of hash and number, and is sorted in among them.
    """

    def numbered(s: Column) -> Column:
        same = lambda a, b: _right(F.get(s, a), bits) == _right(F.get(s, b), bits)
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | ~same(j, j - 1))

        def keyed(first: Column) -> Column:
            runs = F.filter(
                F.transform(first, lambda a, r: F.struct(
                    a.alias("a"), (F.coalesce(F.get(first, r + 1), F.size(s)) - a).alias("n"))),
                lambda run: run["n"] > 1)
            place = lambda j: _place(F.get(s, j), bits)
            further = F.flatten(F.transform(runs, lambda run: F.transform(
                F.sequence(F.lit(1), run["n"] - 1), lambda k: _packed(
                    F.xxhash64(F.get(hashes, (place(run["a"]) - 1).cast("int")), k), place(run["a"] + k), bits))))
            return F.sort_array(F.concat(F.transform(first, lambda a: F.get(s, a)), F.sort_array(further)))

        return _bind(starts, keyed)

    return _bind(F.sort_array(F.transform(hashes, lambda x, i: _packed(x, i + 1, bits))),
                 lambda s: F.when(F.size(F.array_distinct(hashes)) == F.size(s), s).otherwise(numbered(s)))


def order_minhash(text: Column) -> Column:
    """Signature of a text: ENTRIES numbers of 32 bits, none for a text without units.

    The keys of the occurrence-numbered k-mers are uniform numbers. Entry e ranks them by how
    far above e / ENTRIES of the ring of 64-bit numbers they lie, a permutation of its own, takes
    the TUPLE lowest of it, puts them in text order and hashes their k-mers in that order. One
    sorted array serves all entries: their places on the ring are sorted in among the keys. A
    text of fewer than TUPLE k-mers takes those that it has.
    """
    step = 2 ** 64 // ENTRIES
    marks = F.array(*[F.lit(e * step - 2 ** 63).cast("long") for e in range(ENTRIES)])  # place 0, which no key has

    def signed(hashes: Column, bits: Column) -> Column:
        n = F.size(hashes)
        take = F.sequence(F.lit(0), F.least(n, F.lit(TUPLE)) - 1)

        def entries(keys: Column) -> Column:
            def entry(mark: Column, e: Column) -> Column:
                lowest = F.transform(take, lambda j: _place(F.get(keys, F.pmod(mark - e + j, n)), bits))  # e marks lie before
                kmer = lambda p: F.get(hashes, (p - 1).cast("int"))
                return F.shiftright(F.xxhash64(F.transform(F.sort_array(lowest), kmer)), 32).cast("int")

            return _bind(F.sort_array(F.concat(marks, keys)), lambda mixed: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(mixed) - 1), lambda p: _place(F.get(mixed, p), bits) == 0), entry))

        return _bind(occurrences(hashes, bits), entries)

    made = _bind(kmers(text), lambda h: F.when(F.size(h) > 0, _bind(_place_bits(h), lambda bits: signed(h, bits))))
    return F.coalesce(made, F.array().cast("array<int>"))


def digits(signature: Column) -> Column:
    """A signature as one string, 8 hex digits an entry."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(
        F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two signatures; 1 for two empty ones, 0 if only one is empty."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(equal / most)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows of `docs` with the Order MinHash of a text column, as a string of hex digits.

    Whole texts are read, at any length: time is that of sorting a text's own k-mers; nothing is
    shuffled. Equal texts have equal fingerprints; null and empty texts and texts of nothing but
    blanks have an empty one. Repeated rows, extra columns and an empty table stay as they are; a
    column named as `out` is replaced.
    """
    return docs.withColumn(out, digits(order_minhash(F.col(text))))


def successors(keys: DataFrame) -> DataFrame:
    """(key, next_key): the next of `keys` (doc_id, key) by descending id, after the last the first.

    Null ids come last, rows of one id by key. Spark sorts by ranges, the rows of each range are
    counted, and with the totals before its range each row has its number; the next row is met by
    an equi-join on it. No task sees more than its range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(
        keys.select("doc_id", "key").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("key", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = ranged.join(F.broadcast(offsets), "part").select("key", (F.col("offset") + F.col("row")).alias("place"))
    total = F.lit(ranged.count())
    ahead = placed.select(F.col("key").alias("next_key"), F.pmod(F.col("place") - 1, total).alias("place"))
    return materialize(placed.join(ahead, "place").select("key", "next_key"), "successors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """What one edit does to fingerprints: a row per row of `docs`, which has doc_id and text.

    The edited text has its last third, in whole code points, replaced by the beginning of the
    next document by descending id, the first one after the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the edited text) and
    near_next (likeness to the next document).

    Rows of equal id and text take one place in the order and have equal results; rows of one id
    and different texts follow each other by a digest of both; null ids come last. Null texts
    are empty. An only document is its own next. An empty table gives no rows; extra columns are
    not read. Each different text is shuffled once, whole, and the beginning that its neighbour
    takes over once more, so a task holds a few texts at a time, whatever the keys.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit(":"), whole)
    texts = docs.select("doc_id", whole.alias("text"), F.unhex(F.sha2(named, 256)).alias("key"))
    once = materialize(
        texts.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                     order_minhash(F.col("text")).alias("signature"))
        .groupBy("key").agg(F.count("*").alias("copies"), *[
            F.first(c).alias(c) for c in ("doc_id", "n_chars", "signature")]), "signatures")
    following = successors(once)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    asked = following.join(once.select("key", third.alias("third")), "key")
    different = texts.select("key", "text").dropDuplicates(["key"])
    heads = different.withColumnRenamed("key", "next_key").join(asked, "next_key").select(
        "key", "third", F.col("text").substr(F.lit(1), F.col("third")).alias("head"))
    edited = different.join(heads, "key").select("key", F.concat(
        F.col("text").substr(F.lit(1), F.char_length("text") - F.col("third")), "head").alias("edited"))
    shown = edited.select("key", F.sha2("edited", 256).alias("edited_sha256"),
                          order_minhash(F.col("edited")).alias("edited_signature"))
    nexts = following.join(once.select(
        F.col("key").alias("next_key"), F.col("signature").alias("next_signature")), "next_key").select("key", "next_signature")
    return (
        once.join(nexts, "key").join(shown, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "n_chars", "edited_sha256", digits(F.col("signature")).alias("fingerprint"),
                digits(F.col("edited_signature")).alias("edited_fingerprint"),
                likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
    )
