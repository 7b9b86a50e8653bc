"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from geohour.llm.common import connected_components, free_name
from geohour.session import materialize

SEED = 42
RADIUS = 3
SHINGLE = 3
# Fingerprints within RADIUS bits agree on at least BLOCKS - RADIUS of BLOCKS blocks of bits.
BLOCKS = 6
PIVOTS = 16
# A larger run of fingerprints with one key is cut once more, by parts of the other bits.
SPLIT_ABOVE = 2048
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _masks() -> list[int]:
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, BLOCKS - RADIUS)]


MASKS = np.array(_masks(), np.uint64)
# Reference fingerprints: hashes of their numbers.
REFERENCES = np.array([_hash(str(i).encode()) for i in range(PIVOTS)], np.uint64)


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of lower-cased words, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the bytes 0x20, 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return _hash(b" ".join(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    h = np.fromiter(
        (_hash(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # 64 bytes per hash
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@arrow_udf(LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    got = [fingerprint(t) for t in text.fill_null("").cast(pa.binary()).to_pylist()]
    return pa.array(np.array(got, np.uint64).view(np.int64))


def distance_table(f: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(f[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _spread(f: np.ndarray, table: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """[(members, root)] of the linked members, which need not be all pairs.

    Goes on from each member found to those not yet found. A pair whose distances to any
    reference differ by more than RADIUS cannot be within RADIUS (triangle inequality) and is
    discarded; the survivors are verified. A dense group is found in a few steps.
    """
    left, links = np.arange(len(f)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            near = np.flatnonzero(np.abs(table[left] - table[at]).max(axis=1) <= RADIUS)
            near = near[np.bitwise_count(f[left[near]] ^ f[at]) <= RADIUS]
            if len(near):
                links.append((left[near], root))
                queue += left[near].tolist()
                left = np.delete(left, near)
    return links


def link_run(f: np.ndarray, table: np.ndarray, mask: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints that agree on the bits of `mask`.

    In a large run the other bits are cut into RADIUS + 1 parts, one of which two linked
    fingerprints share, so each part's runs are searched alone and no link is lost.
    """
    if len(f) <= SPLIT_ABOVE:
        return [(f[m], np.full(len(m), f[r])) for m, r in _spread(f, table)]
    free = [i for i in range(64) if not mask >> i & 1]
    links = []
    for k in range(RADIUS + 1):
        part = np.uint64(sum(1 << i for i in free[k::RADIUS + 1]))
        order = np.argsort(f & part, kind="stable")
        edges = np.flatnonzero(np.diff(f[order] & part)) + 1
        for run in np.split(order, edges):
            if len(run) > 1:
                links += [(f[run[m]], np.full(len(m), f[run[r]])) for m, r in _spread(f[run], table[run])]
    return links


def _link_sorted(batches):
    """Links from rows (combo, key, fp) sorted by combo and key; a run may span batches."""
    kept = None

    def links(combo, key, fp):
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(combo) != 0)) + 1
        edges = np.concatenate([[0], cut, [len(key)]])
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        ta, tb = distance_table(a), distance_table(b)
        ok = np.abs(ta - tb).max(axis=1, initial=0) <= RADIUS
        ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= RADIUS
        out = [(b[ok], a[ok])]
        for start, n in zip(edges[:-1][size > 2], size[size > 2]):
            f = fp[start:start + n]
            out += link_run(f, distance_table(f), int(MASKS[combo[start]]))
        x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        return pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if not len(new[0]):
            continue
        got = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        last = np.flatnonzero((got[0] != got[0][-1]) | (got[1] != got[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*[x[:cut] for x in got])
        kept = [x[cut:] for x in got]
    if kept is not None and len(kept[0]):
        yield links(*kept)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the distinct values of `fp` within RADIUS bits.

    Pivot distances alone are no join key (two unrelated fingerprints pass one reference in
    about half of all cases), so candidates share the bits of BLOCKS - RADIUS blocks, one row
    per choice of blocks; the distance table then discards and the fingerprints verify. Only
    links that span a run are emitted, never all pairs of it.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(int(m.view(np.int64))).alias("mask"))
                      for i, m in enumerate(MASKS)])
    keyed = prints.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.combo").alias("combo"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    return keyed.repartition("combo", "key").sortWithinPartitions("combo", "key").mapInArrow(
        _link_sorted, "a long, b long")


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, in_component): one row per row of `docs`.

    component_id is the smallest doc_id of all rows that the row reaches over links between
    fingerprints. Null and empty texts have fingerprint 0 and link like others. Equal rows get
    equal results; null ids take part but are never the smallest, so a component of null ids
    only has a null component_id. An empty table gives no rows.
    """
    prints = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp")), "simhash-components")
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "low", "root")
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    found = linked.join(least, "root").select("fp", "component_id")
    both = distinct.join(found, "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(both, "fp")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`; see `group_documents`."""
    return group_documents(docs, doc_id, text).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: one row of each component, its smallest doc_id.

    Rows that share that id and component count as repeats, of which one stays. Rows with a
    null id stay only where their whole component has null ids; such components count as one.
    Columns are those of `docs`.
    """
    own, fp, root = (free_name(docs, n) for n in ("__own", "__fp", "__root"))
    grouped = materialize(group_documents(docs.select("doc_id", "text")), "simhash-groups")
    first = grouped.where("doc_id <=> component_id")

    def only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias(own)).distinct()
        return rows.join(ids, rows["doc_id"].eqNullSafe(ids[own]), how)

    kept = only(docs, first, "left_semi")
    # Ids that are first more than once, or first in one component and also in another.
    repeated = materialize(
        grouped.groupBy("doc_id").agg(
            F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("n"),
            F.count_if(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("others"))
        .where("n > 1 OR n = 1 AND (others > 0 OR doc_id IS NULL)").select("doc_id"), "simhash-repeats")
    if repeated.isEmpty():
        return kept
    # Rows that share their id: name them by their fingerprint and take one per component.
    again = only(kept, repeated, "left_semi").withColumn(fp, fingerprints(F.col("text")))
    roots = first.select(F.col("fp").alias(root + "_fp"), F.col("component_id").alias(root)).distinct()
    one = (
        again.join(roots, (F.col(fp) == F.col(root + "_fp")) & F.col("doc_id").eqNullSafe(F.col(root)))
        .dropDuplicates(["doc_id", root]).select(*[F.col(f"`{c}`") for c in docs.columns])
    )
    return only(kept, repeated, "left_anti").unionByName(one)
