"""Structural scan of JSON documents in splits: where their elements begin and end.

A document of any size is read in splits, in pieces that end at a closing brace. What a piece
means depends on what came before: whether it begins inside a string, how deep it lies and
whether the array around it holds the elements. Each split is summed up for every such
beginning, the sums are composed per file in split order, and the split is read again from its
true beginning. So no boundary depends on what strings contain, on the order of members or on
line breaks. Files of one split are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from geohour.session import materialize

_QUOTE, _ESCAPE, _NEWLINE = ord('"'), ord("\\"), ord("\n")
_BETWEEN = b" \t\r\n,\x1e\xef\xbb\xbf"  # may stand between elements; with a byte order mark
_SPLIT = [("file", pa.string()), ("block", pa.int64())]
_RISES = [*_SPLIT, *[(f"inside_{c}", pa.bool_()) for c in "01"], *[(f"rise_{c}", pa.int64()) for c in "01"]]
_COUNTS = [*_SPLIT, *[(f"holds_{c}", pa.bool_()) for c in "01"], *[(f"elements_{c}", pa.int64()) for c in "01"],
           ("roots", pa.int64())]
_SPANS = [*_SPLIT, ("n", pa.int64()), ("kind", pa.string()), ("number", pa.int64()), ("starts", pa.bool_()),
          ("ends", pa.bool_()), ("holds", pa.bool_()), ("text", pa.binary())]
_DDL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
_START = ("inside", "depth", "holds", "roots", "elements")


def _ddl(fields: list[tuple]) -> str:
    return ", ".join(f"{name} {_DDL[kind]}" for name, kind in fields)


@dataclass
class Brackets:
    """Brackets outside strings: places, +1 or -1, and which begin a line; the quotes; the end."""

    at: np.ndarray
    rise: np.ndarray
    leads: np.ndarray
    quotes: np.ndarray
    inside: bool


def brackets(data: bytes, inside: bool) -> Brackets:
    """`inside`: the text begins in a string. A line break ends a string, as JSON has none in it."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    plain = np.flatnonzero(raw != _ESCAPE)
    k = np.searchsorted(plain, quotes) - 1  # the last byte before a quote that is no backslash
    before = np.where(k >= 0, plain[np.maximum(k, 0)] if len(plain) else -1, -1)
    quotes = quotes[(quotes - before) % 2 == 1]
    breaks = np.flatnonzero(raw == _NEWLINE)
    quotes_before_break = np.concatenate([[0], np.searchsorted(quotes, breaks)])
    opens = (raw == ord("{")) | (raw == ord("["))
    at = np.flatnonzero(opens | (raw == ord("}")) | (raw == ord("]")))

    def within(places: np.ndarray) -> np.ndarray:
        line = np.searchsorted(breaks, places)
        odd = (np.searchsorted(quotes, places) - quotes_before_break[line]) % 2 == 1
        return odd ^ ((line == 0) & inside)

    at = at[~within(at)]
    leads = opens[at] & (at > 0) & (raw[np.maximum(at - 1, 0)] == _NEWLINE)
    return Brackets(at, np.where(opens[at], 1, -1), leads, quotes, bool(within(np.array([len(raw)]))[0]))


def _key_before(data: bytes, quotes: np.ndarray, at: int) -> bytes | None:
    """The key whose value begins at a place."""
    k = int(np.searchsorted(quotes, at))
    if k < 2 or data[quotes[k - 1] + 1:at].strip() != b":":
        return None
    return data[quotes[k - 2] + 1:quotes[k - 1]]


@dataclass
class Walk:
    """Goes through one split and cuts it into spans of elements and of what is around them.

    The root of a document lies at depth 1, the array `key` of its elements at depth 2, an
    element at depth 3. A root without that array is an element itself.
    """

    key: bytes
    inside: bool = False
    depth: int = 0
    holds: bool = False  # the array around is the one of the elements
    roots: int = 0
    elements: int = 0
    keep: bool = True
    held: bytes = b""  # of the span that is open
    starts: bool = False
    n: int = 0
    spans: list[tuple] = field(default_factory=list)

    def put(self, kind: str, text: bytes, ends: bool = False, holds: bool = False) -> None:
        """Close a span of the held bytes and `text`; what follows continues it or is new."""
        text, self.held = self.held + text, b""
        starts, self.starts = self.starts, False
        if kind == "between":
            text, starts, ends = text.strip(_BETWEEN), True, True
        if self.keep and text:
            number = self.elements if kind == "element" else self.roots
            self.spans.append((self.n, kind, number, starts, ends, holds, text))
            self.n += 1

    def kind(self, depth: int) -> str:
        if depth <= 0 or (self.holds and depth == 2):
            return "between"
        return "element" if self.holds and depth > 2 else "root"

    def feed(self, data: bytes) -> None:
        b = brackets(data, self.inside)
        after = self.depth + np.cumsum(b.rise)
        # Elements begin and end near the top; deeper brackets matter where they begin a line.
        told = np.flatnonzero(np.where(b.rise > 0, (after <= 3) | b.leads, after <= 2))
        done = 0
        for at, depth, opens, leads in zip(
                b.at[told].tolist(), after[told].tolist(), (b.rise[told] > 0).tolist(), b.leads[told].tolist()):
            if opens and depth == 2:
                self.holds = data[at] == ord("[") and _key_before(data, b.quotes, at) == self.key
            if opens and depth == 2 and self.holds:
                self.put("root", data[done:at + 1], holds=True)
                done = at + 1
            elif opens and depth == 1:
                self.put("between", data[done:at])
                done, self.starts, self.holds = at, True, False
                self.roots += 1
            elif opens and depth == 3 and self.holds:
                self.put("between", data[done:at])
                done, self.starts = at, True
                self.elements += 1
            elif opens and leads and not self.holds:
                self.put(self.kind(depth - 1), data[done:at])  # a line that may be a document after a broken one
                done = at
            elif not opens and depth == 2 and self.holds:
                self.put("element", data[done:at + 1], ends=True)
                done = at + 1
            elif not opens and depth == 1 and self.holds:
                self.put("between", data[done:at])
                done, self.holds = at, False
            elif not opens and depth == 0:
                self.put("root", data[done:at + 1], ends=True)
                done, self.holds = at + 1, False
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside = b.inside
        self.held = self.held + data[done:] if self.keep else b""

    def finish(self) -> None:
        if self.depth < 0:  # the presumed brace of a file that ends behind its last one
            self.held = self.held.removesuffix(b"}")
        self.put(self.kind(self.depth), b"")


def _splits(batches: Iterator[pa.RecordBatch], begin: Callable, rows: Callable, fields: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Feed the pieces of each split to what `begin` makes; `rows` turns it into rows in the end."""
    schema = pa.schema(fields)

    def table(of: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in of], schema)

    split, walk = None, None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        cuts = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for a, z in zip([0, *cuts], [*cuts, len(files)]):
            if z == a:
                continue
            if split != (files[a], blocks[a]):
                if walk is not None:
                    yield table([(*split, *r) for r in rows(walk, True)])
                split, walk = (files[a], blocks[a]), begin(batch, a)
            walk.feed(b"}".join(batch.column("value").slice(a, z - a).to_pylist()) + b"}")
            done = rows(walk, False)
            if done:
                yield table([(*split, *r) for r in done])
    if walk is not None:
        yield table([(*split, *r) for r in rows(walk, True)])


class _Rises:
    """Where the strings end and how far the depth rises, begun outside and inside a string."""

    def __init__(self) -> None:
        self.inside, self.rise = [False, True], [0, 0]

    def feed(self, data: bytes) -> None:
        for i in (0, 1):
            b = brackets(data, self.inside[i])
            self.inside[i] = b.inside
            self.rise[i] += int(b.rise.sum())


def _rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _splits(batches, lambda batch, i: _Rises(),
                   lambda w, end: [(*w.inside, *w.rise)] if end else [], _RISES)


class _Both:
    """The walk with and without the array around the beginning being that of the elements."""

    def __init__(self, key: bytes, inside: bool, depth: int) -> None:
        self.walks = [Walk(key, inside, depth, holds, keep=False) for holds in (False, True)]

    def feed(self, data: bytes) -> None:
        for w in self.walks:
            w.feed(data)


def _counts(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _splits(
            batches, lambda batch, i: _Both(key, batch.column("inside")[i].as_py(), batch.column("depth")[i].as_py()),
            lambda w, end: [(*[x.holds for x in w.walks], *[x.elements for x in w.walks], w.walks[0].roots)] if end else [],
            _COUNTS)

    return run


def _spans(key: bytes) -> Callable:
    def rows(walk: Walk, end: bool) -> list[tuple]:
        if end:
            walk.finish()
        out, walk.spans = walk.spans, []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _splits(batches, lambda batch, i: Walk(key, *[batch.column(c)[i].as_py() for c in _START]), rows, _SPANS)

    return run


def _before(of: Column) -> Column:
    """`of` the splits of the file that come before."""
    return of.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def split_starts(pieces: DataFrame, key: str) -> DataFrame:
    """(file, block, inside, depth, holds, roots, elements) where each split of a longer file begins."""
    longer = pieces.where("NOT whole").select("file", "block", "value")
    rises = materialize(longer.mapInArrow(_rises, _ddl(_RISES)), "json-rises")

    def started(df: DataFrame, no: str, yes: str, out: str) -> DataFrame:
        settled = F.col(no) == F.col(yes)
        turns = F.sum(F.when(~settled & F.col(no), 1).otherwise(0))
        order = Window.partitionBy("file").orderBy("block")
        df = df.withColumn("turned", turns.over(order.rowsBetween(Window.unboundedPreceding, 0)))
        known = _before(F.last(F.when(settled, F.struct(F.col(no).alias("state"), "turned")), ignorenulls=True))
        so_far = F.coalesce(_before(F.last("turned")), F.lit(0))
        since = so_far - F.coalesce(known["turned"], F.lit(0))
        return df.withColumn(out, F.coalesce(known["state"], F.lit(False)) != (since % 2 == 1)).drop("turned")

    deep = started(rises, "inside_0", "inside_1", "inside").withColumn(
        "rise", F.when(F.col("inside"), F.col("rise_1")).otherwise(F.col("rise_0")))
    deep = materialize(deep.select(
        "file", "block", "inside", F.coalesce(_before(F.sum("rise")), F.lit(0)).alias("depth")), "json-depths")
    counts = materialize(
        longer.join(F.broadcast(deep), ["file", "block"]).mapInArrow(_counts(key.encode()), _ddl(_COUNTS)), "json-counts")
    held = started(counts, "holds_0", "holds_1", "holds").withColumn(
        "new", F.when(F.col("holds"), F.col("elements_1")).otherwise(F.col("elements_0")))
    numbered = held.select(
        "file", "block", "holds", F.coalesce(_before(F.sum("roots")), F.lit(0)).alias("roots"),
        F.coalesce(_before(F.sum("new")), F.lit(0)).alias("elements"))
    return deep.join(numbered, ["file", "block"])


def spans(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, block, n, kind, number, starts, ends, holds, text) of all documents below a path.

    `kind` is element for what lies in the array `key` of a document's root, root for the rest
    of the document, between for what lies outside both but should not. An element or root that
    two splits share has a span in each, of the same number. The beginnings of splits are
    broadcast: some 100 bytes for each split of a file that has several, so they grow as
    the input divided by the split size.

    A last brace that a file lacks is presumed. A line break inside a string ends the string.
    """
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("whole"),
        F.col("value").cast("binary").alias("value"))
    starts = materialize(split_starts(pieces, key), "json-starts")
    zero = {"inside": F.lit(False), "holds": F.lit(False)}
    begun = pieces.join(F.broadcast(starts), ["file", "block"], "left").select(
        "file", "block", "value", *[F.coalesce(c, zero.get(c, F.lit(0).cast("long"))).alias(c) for c in _START])
    return begun.mapInArrow(_spans(key.encode()), _ddl(_SPANS))
