"""Quality rules: statistics of a text and boosted trees over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from geohour.llm.common import struct_type

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
# What the trees see, and in which direction each may move the verdict (0: either).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1,
    "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": 0,
    "distinct_share": 0, "words_per_line": 0,
}
MAX_TRAIN_ROWS = 20_000  # labelled rows that the fit may read
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b".,;:!?-\"'()"


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside a 3-word window that occurs twice or more, distinct words)."""
    known = dict.fromkeys(words)
    for i, w in enumerate(known):
        known[w] = i
    n, v = len(words), len(known)
    if n < 4:
        return 0, v
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # keeps three ids within 63 bits, however many words a text has
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= hit
    return int(cover.sum()), v


def text_counts(text: bytes, points: int) -> tuple[int, ...]:
    """COUNTS and EXTRA of one text; `points` are its code points."""
    words = text.split()  # exactly the bytes 0x20 and 0x09 to 0x0D
    lines = [x for x in text.split(b"\n") if x.strip()]
    blank = len(text) - len(text.translate(None, b" \t\n\r\x0b\x0c"))

    def among(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    repeat, distinct = _repeat_words(words)
    return (
        len(words), points - blank, among(SYMBOLS), len(lines) - len(set(lines)), repeat,
        len(lines), among(_UPPER), among(_DIGITS), among(_MARKS), distinct,
    )


def counts_frame(text: pa.Array) -> pd.DataFrame:
    column = text.fill_null("")
    points = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    rows = [text_counts(t, int(n)) for t, n in zip(column.cast(pa.binary()).to_pylist(), points)]
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(COUNTS + EXTRA)),
                        columns=COUNTS + EXTRA)


def struct_of(frame: pd.DataFrame) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(frame[c]) for c in frame], list(frame))


@arrow_udf(struct_type(", ".join(f"{c} long" for c in COUNTS + EXTRA)))
def count_texts(text: pa.Array) -> pa.Array:
    return struct_of(counts_frame(text))


def features(counts: pd.DataFrame) -> np.ndarray:
    """FEATURES of each row of counts."""
    c = {k: counts[k].to_numpy(np.float64) for k in COUNTS + EXTRA}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words,
        c["n_distinct"] / words, words / np.maximum(c["n_lines"], 1),
    ])


@dataclass
class Forest:
    """Trees as flat node arrays: a node's children follow each other; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.child[at] >= 0
            go = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
            at = np.where(inner, go, at)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3,
               rate: float = 0.3, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Boosted trees for the log-odds of y, non-decreasing (sign 1) or non-increasing (-1).

    Splits of a constrained feature whose leaf values go the wrong way are not made, and the
    middle of the two values bounds all leaves below, so the whole forest is monotonic. Without
    rows, or with one class, the forest is a constant.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else
            np.empty(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    feature, threshold, child, value, roots = [], [], [], [], []
    margin = np.full(len(x), base)

    def node(v: float) -> int:
        feature.append(0), threshold.append(0.0), child.append(-1), value.append(v)
        return len(value) - 1

    for _ in range(trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        best_of = lambda gs, hs, lo, hi: np.clip(gs / (hs + l2), lo, hi)
        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(x)), -np.inf, np.inf, 0)]
        while todo:
            at, rows, lo, hi, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            own = best_of(gs, hs, lo, hi)
            value[at] = rate * float(own)
            margin[rows] += value[at]
            if level == depth or len(rows) < 2 * least:
                continue
            top = (1e-6, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                vl, vr = best_of(gl, hl, lo, hi), best_of(gs - gl, hs - hl, lo, hi)
                gain = (2 * gl * vl - (hl + l2) * vl**2 + 2 * (gs - gl) * vr
                        - (hs - hl + l2) * vr**2 - 2 * gs * own + (hs + l2) * own**2)
                bad = (n < least) | (len(rows) - n < least) | (signs[j] * (vr - vl) < 0)
                gain[bad] = 0
                k = int(gain.argmax())
                if gain[k] > top[0]:
                    top = (gain[k], (j, k, float(vl[k]), float(vr[k])))
            if top[1] is None:
                continue
            j, k, vl, vr = top[1]
            margin[rows] -= value[at]
            left = node(0.0)
            right = node(0.0)
            feature[at], threshold[at], child[at], value[at] = j, float(cuts[j][k]), left, 0.0
            mid = (vl + vr) / 2
            low_side = (lo, mid) if signs[j] > 0 else (mid, hi) if signs[j] < 0 else (lo, hi)
            high_side = (mid, hi) if signs[j] > 0 else (lo, mid) if signs[j] < 0 else (lo, hi)
            goes = binned[rows, j] > k
            todo += [(left, rows[~goes], *low_side, level + 1), (right, rows[goes], *high_side, level + 1)]
    return Forest(np.array(feature, int), np.array(threshold), np.array(child, int),
                  np.array(value), np.array(roots, int), depth, base)


def labelled_counts(docs: DataFrame, labels: DataFrame, grades: tuple[str, ...],
                    max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """`grades` and text of at most `max_rows` labelled documents, the first by hash of their id.

    Only the sampled ids, whose number is bounded, are broadcast to the documents.
    """
    sample = (
        labels.where("doc_id IS NOT NULL")
        .select("doc_id", *[F.col(c).alias(f"__{c}") for c in grades]).dropna()
        .groupBy("doc_id").agg(*[F.max(f"__{c}").alias(f"__{c}") for c in grades])
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Forest:
    """Trees for quality = 1, from the statistics of at most `max_rows` labelled documents."""
    rows = labelled_counts(docs, labels, ("quality",), max_rows).select(
        count_texts("text").alias("c"), "__quality").select("c.*", "__quality").toPandas()
    order = rows.sort_values(list(rows.columns), kind="stable")  # the fit does not depend on arrival
    return fit_forest(features(order), order["__quality"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, out: str = "rules", text: str = "text",
          least: float = 0.5) -> DataFrame:
    """`docs` and a struct column `out`: COUNTS, base_failed, p_good and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.
    kept: not base_failed and p_good at or above `least`. A null or empty text has no words and
    fails. Each row is judged alone, so repeated rows get equal verdicts; other columns pass
    through whatever their names, as long as `out` is free.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and depth

    @arrow_udf(struct_type(", ".join(f"{c} long" for c in COUNTS)
                           + ", base_failed boolean, p_good double, kept boolean"))
    def verdict(column: pa.Array) -> pa.Array:
        counts = counts_frame(column)
        n, repeat = counts["n_words"], counts["n_repeat_words"]
        got = counts[list(COUNTS)].copy()
        got["base_failed"] = (n < 50) | (100 * repeat > 50 * n)
        got["p_good"] = shared.value.probability(features(counts))
        got["kept"] = ~got["base_failed"] & (got["p_good"] >= least)
        return struct_of(got)

    return docs.withColumn(out, verdict(F.col(text)))
