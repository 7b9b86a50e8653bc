"""Quality classifier: ordinal cumulative-link regression over hashed words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from geohour.llm.common import struct_type
from geohour.llm.quality_rules import labelled_counts, struct_of

BUCKETS = 1 << 18
MAX_TRAIN_ROWS = 6_000  # labelled rows that the fit may read
CACHED_WORDS, CACHED_BYTES = 200_000, 64  # words that are kept, and the longest of them
FORM = 8
_CORE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating 0 to 2: one point for good quality, one for being free of abuse."""
    return (quality + (F.lit(1) - toxic)).cast("int")


class _Buckets(dict):
    """Word to its buckets: of each run of letters in it, and of the form (case and marks around them).

    A long form counts as several of FORM bytes, so nothing of a word is unread.
    """

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        runs = _CORE.findall(word) or [b""]
        case = b"U" if any(r.isupper() and len(r) > 1 for r in runs) else b"l"
        form = _CORE.sub(b"a", word)
        got = (tuple(crc32(b"w" + r.lower()) % BUCKETS for r in runs),
               tuple(crc32(b"f" + case + form[i:i + FORM]) % BUCKETS for i in range(0, len(form), FORM)))
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = got
        return got


def hashed(text: bytes, cache: _Buckets) -> np.ndarray:
    """Buckets present: its runs of letters, its forms with their share of all, and how much repeats."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    runs, shapes = zip(*map(cache.__getitem__, words))
    runs = np.array(list(chain.from_iterable(runs)), np.int64)
    shapes = np.array(list(chain.from_iterable(shapes)), np.int64)
    letters = np.unique(runs)
    forms, n = np.unique(shapes, return_counts=True)
    share = np.searchsorted((0.05, 0.3), n / len(shapes))
    repeats = crc32(b"r%d" % (8 * (len(runs) - len(letters)) // len(runs) if len(runs) >= 20 else -1)) % BUCKETS
    return np.unique(np.concatenate([letters, (forms + share * 7919) % BUCKETS, [repeats]]))


def telling(at: np.ndarray, doc: np.ndarray, low: np.ndarray, least_docs: int, least_z: float) -> np.ndarray:
    """Buckets that the rows in `low` hold more often than the others, beyond chance.

    Only these: a fault is a presence, and words of good texts, which are many in a long text,
    must not make up for it.
    """
    n_low, n_high = max(int(low.sum()), 1), max(int((~low).sum()), 1)
    in_low = np.bincount(at[low[doc]], minlength=BUCKETS)
    in_high = np.bincount(at[~low[doc]], minlength=BUCKETS)
    odds = np.log((in_low + 0.5) / (n_low + 1)) - np.log((in_high + 0.5) / (n_high + 1))
    z = odds / np.sqrt(1 / (in_low + 0.5) + 1 / (in_high + 0.5))
    return np.flatnonzero((z >= least_z) & (in_low + in_high >= least_docs))


@dataclass
class Grader:
    """P(grade <= k) = logistic(thresholds[k] - weights . x), with ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k; they fall with k, as the thresholds rise."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_grader(rows: list[np.ndarray], y: np.ndarray, grades: int = 3, rounds: int = 500,
               rate: float = 0.1, l2: float = 1e-4, least_docs: int = 5, least_z: float = 3.0) -> Grader:
    """Maximum likelihood by Adam on all rows, over the buckets that tell grades apart.

    A bucket tells if it is more frequent below than above some threshold by `least_z` standard
    errors; all others keep weight 0. Thresholds are a first value and positive steps, so they
    are ordered by construction. With no rows the grader is neutral.
    """
    w = np.zeros(BUCKETS, np.float32)
    first, steps = -1.0, np.zeros(grades - 2)
    if not rows:
        return Grader(w, np.concatenate([[first], first + np.cumsum(np.exp(steps))]))
    size = np.array([len(b) for b in rows])
    at = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), size)
    used = np.unique(np.concatenate([
        telling(at, doc, y < k, least_docs, least_z) for k in range(1, grades)]))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[at] >= 0
    at, doc = place[at[keep]], doc[keep]
    theta = np.concatenate([np.zeros(len(used)), [first], steps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, cut = len(rows), len(used)
    for t in range(1, rounds + 1):
        th = np.concatenate([[theta[cut]], theta[cut] + np.cumsum(np.exp(theta[cut + 1:]))])
        score = np.bincount(doc, theta[at], n)
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        with np.errstate(over="ignore"):
            f = 1 / (1 + np.exp(score[:, None] - edge[None, :]))  # P(grade < each edge)
        d = f * (1 - f)
        i = np.arange(n)
        p = np.maximum(f[i, y + 1] - f[i, y], 1e-9)
        by_edge = np.zeros((n, grades + 1))
        by_edge[i, y + 1] += d[i, y + 1] / p
        by_edge[i, y] -= d[i, y] / p
        g_score = -by_edge.sum(axis=1)
        g_th = by_edge[:, 1:-1].sum(axis=0) / n
        grad = np.zeros_like(theta)
        grad[:cut] = np.bincount(at, g_score[doc], cut) / n - l2 * theta[:cut]
        grad[cut] = g_th.sum()
        for k in range(grades - 2):
            grad[cut + 1 + k] = g_th[k + 1:].sum() * np.exp(theta[cut + 1 + k])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[used] = theta[:cut]
    return Grader(w, np.concatenate([[theta[cut]], theta[cut] + np.cumsum(np.exp(theta[cut + 1:]))]))


@arrow_udf(ArrayType(IntegerType()))
def hash_texts(text: pa.Array) -> pa.Array:
    cache = _Buckets()
    got = [hashed(t, cache).astype(np.int32) for t in text.fill_null("").cast(pa.binary()).to_pylist()]
    return pa.array(got, pa.list_(pa.int32()))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Grader:
    """A grader from at most `max_rows` labelled documents. Only hashed words reach the driver."""
    rows = (
        labelled_counts(docs, labels, ("quality", "toxic"), max_rows)
        .select("doc_id", hash_texts("text").alias("at"), grade(F.col("__quality"), F.col("__toxic")).alias("y"))
        .toPandas().sort_values("doc_id", kind="stable")
    )
    return fit_grader(list(rows["at"]), rows["y"].to_numpy(int))


def grade_texts(docs: DataFrame, grader: Grader, out: str = "grading", text: str = "text",
                least_grade: int = 2, least_share: float = 0.92) -> DataFrame:
    """`docs` and a struct column `out`: expected_grade, tail and selected.

    tail is P(grade >= `least_grade`); a text is selected if its tail is at least `least_share`
    of the tail of a text without any telling word, whatever the shares of the grades among the
    labels. Whole texts are read; a null or empty text has score 0. Each row is graded alone, so repeated rows agree; other
    columns pass through whatever their names, as long as `out` is free.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grader)  # BUCKETS weights

    @arrow_udf(struct_type("expected_grade double, tail double, selected boolean"))
    def graded(column: pa.Array) -> pa.Array:
        g, cache = shared.value, _cache
        score = []
        for t in column.fill_null("").cast(pa.binary()).to_pylist():
            score.append(float(g.weights[hashed(t, cache)].sum()))
        tails = g.tails(np.array(score))
        tail = tails[:, least_grade - 1]
        return struct_of(pd.DataFrame({
            "expected_grade": tails.sum(axis=1), "tail": tail,
            "selected": tail >= least_share * g.tails(np.zeros(1))[0, least_grade - 1]}))

    return docs.withColumn(out, graded(F.col(text)))


_cache = _Buckets()
