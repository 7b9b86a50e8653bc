"""Spelling variants: words one edit apart, found by bidirectional FM-indexes over the vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from geohour.llm.common import lower_ascii
from geohour.session import materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT = 6, 5
RATIO = 5  # how much more frequent than a word its form must be
SHARD_ROWS = 8_000  # rows of words and questions that one index is built for, on average
SHARDS_A_TASK = 8
BLOCK = 64  # symbols between two stored counts of an index
ROWS_AT_ONCE = 1 << 16  # states that a step looks at together
QUERIES_AT_ONCE = 2_048
DELETE_EVERY = 199


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): the runs of LETTERS of at least MIN_CHARS in `docs` (doc_id, text), A-Z in lower case.

    Where the crc32 of `<doc_id>:<word>` is a multiple of DELETE_EVERY, the word lacks the letter
    of that number, modulo its length. A null id counts as empty.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text"), F.lit(LETTERS + f"{{{MIN_CHARS},}}"), F.lit(0))).alias("run"))
    low = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(lower_ascii(F.col("run")))
    drawn = runs.select(low.alias("run"), F.crc32(F.concat("id", F.lit(":"), low).cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return drawn.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least `min_chars` code points that occur at least `min_count` times."""
    return (
        words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


def _suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """The rotations of a text in order, by doubling the length that is compared."""
    bits = max(int(symbols).bit_length(), 1)
    width = min(62 // bits, len(text))
    rank = np.zeros(len(text), np.int64)
    for j in range(width):
        rank = (rank << bits) | np.roll(text, -j)
    while True:
        order = np.argsort(rank, kind="stable")
        steps = np.diff(rank[order]) != 0
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        if steps.all() or width >= len(text):
            return order
        rank = rank * len(text) + np.roll(rank, -width)
        width *= 2


class Ranks:
    """How many smaller symbols come before a place of a transformed text."""

    def __init__(self, bwt: np.ndarray, symbols: int) -> None:
        blocks = len(bwt) // BLOCK + 1
        padded = np.full(blocks * BLOCK, symbols, np.int32)
        padded[:len(bwt)] = bwt
        self.rows = padded.reshape(blocks, BLOCK)
        counts = np.bincount(np.repeat(np.arange(blocks), BLOCK) * (symbols + 1) + padded, minlength=blocks * (symbols + 1))
        counts = counts.reshape(blocks, symbols + 1)
        before = np.cumsum(counts, axis=0) - counts
        self.stored = (np.cumsum(before, axis=1) - before).astype(np.int32)  # [block, symbol]: smaller ones before
        self.symbols = symbols

    def smaller(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        within = np.arange(BLOCK)
        for i in range(0, len(at), ROWS_AT_ONCE):
            s, p = symbol[i:i + ROWS_AT_ONCE], at[i:i + ROWS_AT_ONCE]
            block = p // BLOCK
            near = (self.rows[block] < s[:, None]) & (within < (p % BLOCK)[:, None])
            out[i:i + ROWS_AT_ONCE] = self.stored[block, s] + near.sum(axis=1)
        return out

    def all_smaller(self, at: np.ndarray) -> np.ndarray:
        """[place, symbol] for all symbols, and one column more for what would come after the last."""
        block = at // BLOCK
        inside = np.arange(BLOCK) < (at % BLOCK)[:, None]
        row, column = np.nonzero(inside)
        width = self.symbols + 1
        seen = np.bincount(row * width + self.rows[block[row], column], minlength=len(at) * width).reshape(-1, width)
        return self.stored[block] + np.cumsum(seen, axis=1) - seen


@dataclass
class States:
    """Partial matches: their query, how much of it is matched, errors, and both rank intervals."""

    query: np.ndarray
    done: np.ndarray
    error: np.ndarray
    left: np.ndarray  # first rank in the index of the text
    right: np.ndarray  # first rank in the index of the reversed text
    size: np.ndarray

    def take(self, which: np.ndarray) -> States:
        return States(*(getattr(self, f)[which] for f in self.__dataclass_fields__))

    @staticmethod
    def join(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in States.__dataclass_fields__))


class TwoWayIndex:
    """FM-indexes of the words, each behind a delimiter, and of the same text reversed.

    A pattern is a pair of rank intervals of one size, one in each index. It grows by a symbol at
    either end: one index finds the new interval, and the smaller symbols in the old one tell how
    far the other interval moves. The delimiter is the smallest symbol, so the rotation that
    begins at the delimiter of the i-th word in order has rank i.
    """

    def __init__(self, words: list[str]) -> None:
        """`words` are different, not empty, and in code-point order."""
        self.words = words
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.alphabet = np.unique(points)
        self.symbols = len(self.alphabet) + 1
        text = np.zeros(len(points) + len(words), np.int64)
        inner = np.ones(len(text), bool)
        inner[np.cumsum(lengths + 1) - lengths - 1] = False
        text[inner] = np.searchsorted(self.alphabet, points) + 1
        self.begins = np.searchsorted(np.sort(text), np.arange(self.symbols + 1))
        self.size = len(text)
        self.ranks = [Ranks(t[_suffix_order(t, self.symbols) - 1], self.symbols) for t in (text, text[::-1].copy())]

    def encode(self, word: str) -> np.ndarray:
        """Symbols of a word; -1 for letters that no word of the index has."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def grow(self, s: States, symbol: np.ndarray, to_right: bool) -> States:
        """The states that can grow by a symbol of theirs at one end."""
        known = symbol >= 0
        s, symbol = s.take(known), symbol[known]
        ranks, here, there = (self.ranks[1], s.right, s.left) if to_right else (self.ranks[0], s.left, s.right)
        low, high = ranks.smaller(symbol, here), ranks.smaller(symbol, here + s.size)
        low_next, high_next = ranks.smaller(symbol + 1, here), ranks.smaller(symbol + 1, here + s.size)
        here = self.begins[symbol] + low_next - low
        there = there + high - low
        size = (high_next - high) - (low_next - low)
        left, right = (there, here) if to_right else (here, there)
        return States(s.query, s.done, s.error, left, right, size).take(size > 0)

    def branch(self, s: States, to_right: bool) -> tuple[States, np.ndarray]:
        """The states with every letter that can follow, and these letters."""
        out, letters = [], []
        for i in range(0, len(s.query), 1024):
            p = s.take(slice(i, i + 1024))
            ranks, here, there = (self.ranks[1], p.right, p.left) if to_right else (self.ranks[0], p.left, p.right)
            low, high = ranks.all_smaller(here), ranks.all_smaller(here + p.size)
            n_low, n_high = np.diff(low, axis=1), np.diff(high, axis=1)  # each symbol before either end
            row, symbol = np.nonzero(n_high > n_low)
            letter = symbol > 0
            row, symbol = row[letter], symbol[letter]
            grown = self.begins[symbol] + n_low[row, symbol]
            moved = there[row] + high[row, symbol] - low[row, symbol]
            left, right = (moved, grown) if to_right else (grown, moved)
            out.append(States(p.query[row], p.done[row], p.error[row], left, right, n_high[row, symbol] - n_low[row, symbol]))
            letters.append(symbol)
        return States.join(out), np.concatenate(letters)

    def near(self, queries: list[str], first_exact: bool, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words one edit away, the error lying in the other half.

        The exact half is matched from the middle outwards, the delimiter behind it, and then
        the other half from the middle on with exactly one error, up to its delimiter. `own`
        marks queries that are words of the index: while they have no error and are alone in
        their interval, nothing else can be found.
        """
        codes = [self.encode(q) for q in queries]
        exact, rest = [], []
        for c in codes:
            mid = len(c) // 2
            first, last = np.append(c[:mid][::-1], 0), np.append(c[mid:], 0)
            exact.append(first if first_exact else last)
            rest.append(last if first_exact else first)
        n = len(queries)
        start = [np.concatenate([[0], np.cumsum([len(x) for x in part])[:-1]]).astype(np.int64) for part in (exact, rest)]
        size = [np.fromiter((len(x) for x in part), np.int64, n) for part in (exact, rest)]
        flat = [np.concatenate(part) for part in (exact, rest)]
        zero = np.zeros(n, np.int64)
        s = States(np.arange(n), zero, zero, zero, zero, np.full(n, self.size))
        matched = []
        step = 0
        while len(s.query):
            over = size[0][s.query] == step
            matched.append(s.take(over))
            s = s.take(~over)
            s = self.grow(s, flat[0][start[0][s.query] + step], to_right=not first_exact)
            step += 1
        s = States.join(matched) if matched else s
        found = []
        while len(s.query):
            over = s.done == size[1][s.query]
            found.append(s.take(over & (s.error == 1)))
            s = s.take(~over & ~((s.error == 0) & (s.size == 1) & own[s.query]))
            wanted = flat[1][start[1][s.query] + s.done]
            onward = self.grow(s, wanted, to_right=first_exact)
            onward.done = onward.done + 1
            parts = [onward]
            clean = s.error == 0
            if clean.any():
                s, wanted = s.take(clean), wanted[clean]
                lacks = s.take(wanted != 0)  # the word lacks a letter of the query
                parts.append(States(lacks.query, lacks.done + 1, lacks.error + 1, lacks.left, lacks.right, lacks.size))
                other, letter = self.branch(s, to_right=first_exact)
                other.error = other.error + 1
                parts.append(other)  # the word has a letter more
                due = flat[1][start[1][other.query] + other.done]
                swapped = other.take((due != 0) & (due != letter))
                swapped.done = swapped.done + 1
                parts.append(swapped)  # the word has another letter
            s = States.join(parts)
        hits = States.join(found) if found else s
        pairs = np.unique(hits.query * len(self.words) + hits.left)
        return pairs // len(self.words), pairs % len(self.words)


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of the questions of one shard: how many, and the best of them for each question.

    A question of a half that is dealt over several shards counts only the words of its own part:
    others may be here for another half of theirs, and are counted where their part is.
    """
    held = rows[rows["held"]].drop_duplicates("word").sort_values("word", key=lambda w: w.str.encode("utf-32-be"))
    asked = rows[rows["asked"]]
    out = []
    if len(held) and len(asked):
        words, n, deal = held["word"].tolist(), held["n"].to_numpy(), held["deal"].to_numpy()
        index, inside = TwoWayIndex(words), set(words)
        for first_exact in (True, False):
            mine = asked[asked["first"] == first_exact].sort_values("word", key=lambda w: w.str.len(), kind="stable")
            for i in range(0, len(mine), QUERIES_AT_ONCE):
                some = mine.iloc[i:i + QUERIES_AT_ONCE]
                queries, part, parts = some["word"].tolist(), some["part"].to_numpy(), some["parts"].to_numpy()
                q, w = index.near(queries, first_exact, np.array([x in inside for x in queries]))
                own = deal[w] % parts[q] == part[q]
                q, w = q[own], w[own]
                if not first_exact:  # those of the same first half are found by it
                    new = np.fromiter((not words[b].startswith(queries[a][:len(queries[a]) // 2]) for a, b in zip(q, w)), bool, len(q))
                    q, w = q[new], w[new]
                best = np.lexsort((w, -n[w], q))  # words lie in code-point order
                once = best[np.unique(q[best], return_index=True)[1]]
                near = np.bincount(q, minlength=len(queries))
                out += [(queries[q[k]], int(near[q[k]]), int(n[w[k]]), words[w[k]]) for k in once]
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"]).astype({"n_near": "int64", "best_n": "int64"})


def _halves(word: Column) -> Column:
    """The keys of a word: halves that it shares with what asks for it, and those that it asks by.

    A word of L letters asks by its first L // 2 letters and by the others. Whatever is one edit
    away has one letter more or less at most, and shares one of the two with it.
    """
    size = F.char_length(word)

    def keys(change: int) -> list[Column]:
        of = size + change
        half = F.floor(of / 2).cast("int")
        return [F.struct(F.lit(True).alias("first"), word.substr(F.lit(1), half).alias("half"), F.lit(change == 0).alias("asked")),
                F.struct(F.lit(False).alias("first"), word.substr(size - (of - half) + 1, of - half).alias("half"),
                         F.lit(change == 0).alias("asked"))]

    # two lengths may have the same half; it asks if one of them does
    same = F.array(*keys(0))
    others = F.filter(F.array(*keys(-1), *keys(1)), lambda k: ~F.exists(
        same, lambda s: (s["first"] == k["first"]) & (s["half"] == k["half"])))
    return F.concat(same, F.array_distinct(others))


def near_words(vocab: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n_near, best): near words of each word that has any; `best` is (-n, word) of the first.

    Words meet by halves: a shard of the vocabulary holds all words of its halves, builds a
    two-way index of them and answers the questions by these halves. A half of more words than a
    shard holds is counted by Spark and dealt over several shards, which all get its questions.
    """
    keyed = vocab.select("word", "n", F.explode(_halves(F.col("word"))).alias("k")).select("word", "n", "k.*")
    keyed = materialize(keyed, "halves")
    sizes = keyed.groupBy("first", "half").agg(F.count("*").alias("rows"))
    large = materialize(sizes.where(F.col("rows") > shard_rows).select(
        "first", "half", F.ceil(F.col("rows") / shard_rows).cast("int").alias("parts")), "large-halves")
    shards = max(-(-keyed.count() // shard_rows), 1)
    cut = keyed.join(large, ["first", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("deal", F.xxhash64("word"))
    home = F.pmod("deal", F.col("parts")).cast("int")
    parts = F.when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(home))
    dealt = cut.withColumn("part", F.explode(parts)).select(
        F.pmod(F.xxhash64("first", "half", "part"), F.lit(shards)).alias("shard"), "first", "word", "n", "asked",
        "deal", "part", "parts", (F.col("part") == home).alias("held"))
    # A given number, which is not coalesced: these rows are few bytes but much work.
    dealt = dealt.repartition(-(-shards // SHARDS_A_TASK), "shard")
    found = dealt.groupBy("shard").applyInPandas(_search, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))).alias("best"))


def group_variants(vocab: DataFrame, ratio: int = RATIO, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the spelling that each word of `vocab` (word, n) varies.

    Two words are near if one inserted, deleted or replaced code point makes one of the other.
    A word's form is its near word of the largest n, the first in code-point order of several, if
    that n is at least `ratio` (over 1) times its own; else null. Its root is reached from form
    to form, the word itself without a form.

    Rows that repeat a word add up; null and empty words are left out; words may be of any
    length; an empty table gives no rows; extra columns are not read.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = materialize(
        vocab.where(F.col("word") != "").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    near = near_words(words, shard_rows)
    most = -F.col("best.minus_n")
    fits = most >= ratio * F.col("n")
    formed = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.word")).alias("form"), F.when(fits, most).alias("form_n")), "forms")
    # n grows by the ratio from form to form, so a few doublings of the way reach all roots
    way = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        way = materialize(way, "roots")
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = way.join(onward, "root", "left")
        if further.where("next IS NOT NULL").isEmpty():
            break
        way = further.select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(way, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
