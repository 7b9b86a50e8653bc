"""Exact repeated substrings by externally sorted and induced suffixes.

A repeat of REPEAT bytes is found without sorting all suffixes. Sampled positions (anchors) are
chosen by content, so that each string of REPEAT bytes holds one, at the same place in each of
its copies. Anchored suffixes are grouped by their first KMER bytes, sorted, and all suffixes
up to REPEAT - KMER bytes before them are induced from that order, byte by byte, carrying common
prefix lengths.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from geohour.llm.common import free_name, small, struct_type
from geohour.session import materialize

REPEAT = 200
KMER = 48
LEFT = REPEAT - KMER  # bytes before an anchor that a repeat with it may hold
SPAN = LEFT + REPEAT
CHUNK_BYTES = 192 << 10  # text whose anchors are searched at once; arrays of it fit a cache
SORT_ROWS = 30_000  # anchored suffixes that a task sorts in memory; more are spilled
SPLIT_ROWS = 8192  # kinds of surroundings of one anchor that a single task sorts; more are split
_GAP = 2 * REPEAT  # zero bytes between texts, more than any search looks beyond an end
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` neighbours, in log2(width) steps."""
    step = 1
    while 2 * step <= width:
        a = op(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def find_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash of KMER bytes, hash of the whole surroundings).

    An anchor is a position whose KMER bytes hash lowest in some window of REPEAT bytes; all
    ties are taken. The surroundings are up to LEFT bytes before it and REPEAT bytes from it
    on, within its text.
    """
    size = np.array([len(t) for t in texts], np.int64)
    begin = _GAP + np.cumsum(size + _GAP) - (size + _GAP)
    gap = bytes(_GAP)
    raw = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)) + gap, np.uint8)
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8")[:, 0]
    n = len(word) - KMER + 8
    h = np.full(n, 1, np.uint64)
    for j in range(0, KMER, 8):
        h = _mix(h ^ word[j:j + n])
    low = _slide(h, REPEAT - KMER + 1, np.minimum)
    inside = np.zeros(len(low) + 1, np.int8)
    long = size >= REPEAT
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, (begin + size - REPEAT + 1)[long], -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    best = _slide(np.concatenate([np.zeros(REPEAT - KMER, np.uint64), low]), REPEAT - KMER + 1, np.maximum)
    at = np.flatnonzero((best == h[:len(best)]) & (best > 0))
    text = np.searchsorted(begin, at, side="right") - 1
    pos = at - begin[text]
    left, right = np.minimum(pos, LEFT), np.minimum(size[text] - pos, REPEAT)
    around = (left * 1024 + right).astype(np.uint64)
    for j in range(-LEFT, REPEAT, 8):
        around = _mix(around ^ word[at + j]) + np.uint64(j & 511)
    return text, pos, h[at], around


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _batches_by_size(texts: list[bytes]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _anchor_rows(batches):
    for batch in batches:
        texts = _bytes_of(batch.column(2))
        for a, b in _batches_by_size(texts):
            text, pos, kmer, around = find_anchors(texts[a:b])
            row = pa.array(text + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmer.view(np.int64)), pa.array(around.view(np.int64)),
                 batch.column(0).take(row), batch.column(1).take(row), pa.array(pos.astype(np.int32))],
                ["kmer", "around", "doc_id", "text_key", "pos"])


def _lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a list-of-struct column laid end to end, and where each row's part ends."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    return [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)], np.cumsum(sizes)


def _segment_rows(batches):
    """The surroundings of the wanted anchors: SPAN bytes, zero outside the text."""
    for batch in batches:
        (pos, kmer), ends = _lists(batch.column(3))
        if not len(pos):
            continue
        seg, right = np.empty((len(pos), SPAN), np.uint8), np.empty(len(pos), np.int16)
        begin = 0
        for z, end in zip(batch.column(2).to_pylist(), ends.tolist()):
            t, at = zstandard.decompress(z), pos[begin:end]
            raw = np.frombuffer(bytes(LEFT) + t + bytes(REPEAT), np.uint8)
            seg[begin:end] = np.lib.stride_tricks.sliding_window_view(raw, SPAN)[at]
            right[begin:end] = np.minimum(len(t) - at, REPEAT)
            begin = end
        row = pa.array(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)))
        edges = np.arange(len(pos) + 1, dtype=np.int32) * SPAN
        yield pa.RecordBatch.from_arrays(
            [pa.array(kmer), batch.column(0).take(row), batch.column(1).take(row), pa.array(pos.astype(np.int32)), pa.array(right),
             pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(edges), pa.py_buffer(seg)])],
            ["kmer", "doc_id", "text_key", "pos", "right", "seg"])


class SuffixQueue:
    """Suffix tuples (number, common prefix with the one before) by preceding byte.

    A priority queue for induction: tuples are taken out by byte, those of one byte in order of
    arrival. More than `limit` tuples are written to files in `folder`, one per byte.
    """

    def __init__(self, limit: int, folder: str):
        self.limit, self.folder, self.held = limit, folder, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, object] = {}

    def push(self, byte: np.ndarray, tuples: np.ndarray) -> None:
        """`byte` is sorted; tuples of one byte are in order."""
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for b, part in zip(byte[np.concatenate([[0], cuts])].tolist(), np.split(tuples, cuts)):
            self.memory.setdefault(b, []).append(part)
        self.held += len(byte)
        if self.held > self.limit:
            for b, parts in self.memory.items():
                if b not in self.files:
                    self.files[b] = tempfile.TemporaryFile(dir=self.folder)
                for part in parts:
                    self.files[b].write(part.tobytes())
            self.memory, self.held = {}, 0

    def drain(self):
        """Blocks of tuples in order; the queue is empty afterwards."""
        block: list[np.ndarray] = []
        size = 0
        for b in sorted(self.memory.keys() | self.files.keys()):
            parts = list(self.memory.get(b, []))
            if b in self.files:
                f = self.files[b]
                f.seek(0)
                while raw := f.read(self.limit * _TUPLE.itemsize):
                    if size:
                        yield np.concatenate(block)
                        block, size = [], 0
                    yield np.frombuffer(raw, _TUPLE)
                f.close()
            for part in parts:
                block.append(part)
                size += len(part)
                if size >= self.limit:
                    yield np.concatenate(block)
                    block, size = [], 0
        if size:
            yield np.concatenate(block)
        self.memory, self.files, self.held = {}, {}, 0


_TUPLE = np.dtype([("row", "<i8"), ("lcp", "<i4")])


def _range_min(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(a[first..last]) of each query, by doubling tables that are built as far as needed."""
    out = a[last].copy()
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table, step = a, 1
    for k in range(1, int(level.max(initial=0)) + 1):
        table = np.minimum(table[:-step], table[step:])
        step *= 2
        at = level == k
        out[at] = np.minimum(table[first[at]], table[last[at] - step + 1])
    return out


def induce(block: np.ndarray, byte: np.ndarray, pending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block's tuples ordered by preceding byte, with their new common prefixes.

    pending[b] is the smallest common prefix since the last tuple with preceding byte b, in
    this or an earlier block; it is updated. Byte 256 marks suffixes that end the induction.
    The first tuple of a byte gets a prefix too, but one no longer than the bytes induced so
    far: the first tuple of all began with 0. That is below all that callers look for.
    """
    lcp = block["lcp"]
    order = np.argsort(byte, kind="stable")
    b = byte[order]
    head = np.concatenate([[True], b[1:] != b[:-1]])
    new = np.empty(len(b), np.int32)
    so_far = np.minimum.accumulate(lcp)
    new[head] = np.minimum(so_far[order[head]], pending[b[head]])
    rest = np.flatnonzero(~head)
    new[rest] = _range_min(lcp, order[rest - 1] + 1, order[rest])
    tail = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [np.iinfo(np.int32).max]])
    np.minimum(pending, so_far[-1], out=pending)
    last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(b) - 1]])
    pending[b[last]] = tail[order[last] + 1]
    return order, new + 1


def _sorted_rows(seg: np.ndarray, kmer: np.ndarray, folder: str):
    """Rows by (kmer, bytes from the anchor on) in blocks: sorted runs, merged if several."""
    import heapq

    key = np.ascontiguousarray(seg[:, LEFT:]).view(f"S{REPEAT}")[:, 0] if len(seg) <= SORT_ROWS else None
    if key is not None:
        yield np.lexsort((key, kmer))
        return

    def run(a: int):
        part = np.ascontiguousarray(seg[a:a + SORT_ROWS, LEFT:]).view(f"S{REPEAT}")[:, 0]
        for r in (np.lexsort((part, kmer[a:a + SORT_ROWS])) + a).tolist():
            yield int(kmer[r]), seg[r, LEFT:].tobytes(), r

    block = []
    for _, _, r in heapq.merge(*(run(a) for a in range(0, len(seg), SORT_ROWS))):
        block.append(r)
        if len(block) == SORT_ROWS:
            yield np.array(block)
            block = []
    if block:
        yield np.array(block)


def repeats_of(seg: np.ndarray, kmer: np.ndarray, left: np.ndarray, right: np.ndarray,
               folder: str, limit: int = SORT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(most, least) bytes before the anchor at which a repeat of REPEAT bytes begins; -1: none.

    Rows are anchors with their surroundings. The anchored suffixes are sorted first; step a
    then has the suffixes a bytes before the anchors in order. Two neighbours with REPEAT bytes
    in common are a repeat, as one step holds no position twice. A suffix whose bytes before
    the anchor no neighbour shares is alone at all later steps and leaves the queue.
    """
    most, least = np.full(len(seg), -1), np.full(len(seg), -1)
    queue, last = SuffixQueue(limit, folder), None
    for rows in _sorted_rows(seg, kmer, folder):
        chain = rows if last is None else np.concatenate([[last], rows])
        lcp = np.zeros(len(chain), np.int32)
        a, b = chain[:-1], chain[1:]
        differ = seg[a, LEFT:] != seg[b, LEFT:]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), REPEAT)
        lcp[1:] = np.where(kmer[a] == kmer[b], np.minimum(common, np.minimum(right[a], right[b])), 0)
        made = np.empty(len(rows), _TUPLE)
        made["row"], made["lcp"] = rows, lcp[-len(rows):]
        queue.push(np.zeros(len(rows), np.int16), made)
        last = rows[-1]
    for a in range(LEFT + 1):
        later, pending = SuffixQueue(limit, folder), np.full(257, np.iinfo(np.int32).max, np.int32)
        before, held = None, None
        pushed = 0

        def feed(block: np.ndarray, after: int) -> int:
            """Send a block whose follower has the common prefix `after` to the next step."""
            row, lcp = block["row"], block["lcp"]
            follow = np.append(lcp[1:], after)
            go = (left[row] > a) & (np.maximum(lcp, follow) >= a + KMER)
            byte = np.where(go, seg[row, LEFT - 1 - a].astype(np.int16), np.int16(256))
            order, new = induce(block, byte, pending)
            n = int(go.sum())
            if n:
                made = np.empty(n, _TUPLE)
                made["row"], made["lcp"] = row[order[:n]], new[:n]
                later.push(byte[order[:n]], made)
            return n

        for block in queue.drain():
            row = block["row"]
            twin = np.flatnonzero(block["lcp"] >= REPEAT)
            prev = np.where(twin > 0, row[twin - 1], before if before is not None else -1)
            for hit in (row[twin], prev):
                most[hit] = a
                least[hit] = np.where(least[hit] < 0, a, least[hit])
            if held is not None:
                pushed += feed(held, int(block["lcp"][0]))
            held, before = block, int(row[-1])
        if held is not None and a < LEFT:
            pushed += feed(held, 0)
        queue = later
        if not pushed:
            break
    return most, least


def _induced_rows(batches):
    """(doc_id, text_key, start, stop) of the repeats among rows sorted by kmer.

    Whole groups of one kmer are taken together, many small ones at once. `_split` keeps groups
    within SPLIT_ROWS; one that still grows, by equal rows, goes to disk as it is sorted.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(batch: pa.Table):
        with tempfile.TemporaryDirectory() as folder:
            n = batch.num_rows
            kmer = batch.column(0).to_numpy()
            seg = (np.memmap(f"{folder}/segments", np.uint8, "w+", shape=(n, SPAN)) if n > 4 * SORT_ROWS
                   else np.empty((n, SPAN), np.uint8))
            at = 0
            for chunk in batch.column(5).chunks:  # all values have SPAN bytes
                raw = np.frombuffer(chunk.buffers()[2], np.uint8)
                edge = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset]
                seg[at:at + len(chunk)] = raw[edge:edge + len(chunk) * SPAN].reshape(-1, SPAN)
                at += len(chunk)
            pos, right = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int32)
            left = np.minimum(pos, LEFT)
            most, least = repeats_of(seg, kmer, left, right, folder)
            hit = np.flatnonzero(most >= 0)
            take = pa.array(hit)
            out = pa.Table.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take), pa.array(pos[hit] - most[hit], pa.int64()),
                 pa.array(pos[hit] - least[hit] + REPEAT, pa.int64())], ["doc_id", "text_key", "start", "stop"])
            return out.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        kmer = batch.column(0).to_numpy()
        if rows < SORT_ROWS or held[0].column(0)[0].as_py() == kmer[-1]:
            continue
        # The last group may go on; it began in this batch or in an earlier one.
        tail = []
        while held and held[-1].column(0)[0].as_py() == kmer[-1]:
            tail.insert(0, held.pop())
        cut = int(np.searchsorted(held[-1].column(0).to_numpy(), kmer[-1]))
        if cut < held[-1].num_rows:
            tail.insert(0, held[-1].slice(cut))
            held[-1] = held[-1].slice(0, cut)
        yield from solve(pa.Table.from_batches(held))
        held, rows = tail, sum(x.num_rows for x in tail)
    if held:
        yield from solve(pa.Table.from_batches(held))


def _split(hot: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows in groups of at most SPLIT_ROWS, repeats that are found already) of large groups.

    A repeat begins lo to hi - 1 bytes before its anchor for some range; all its copies then
    agree on the bytes from lo before the anchor to REPEAT - hi + 1 after it. So a large group
    is cut into two halves of its range, each grouped by its own, longer string, until groups
    are small enough. No pair of copies is lost: their range is in one of the halves, with an
    equal string.

    In a group that stays large, anchors that agree on all bytes that any repeat of their range
    can hold are alike: Spark counts them, all of the range is repeated for each, and one of
    them goes on to meet the others. So what is copied to the next round are different
    surroundings; at a range of one there are none left.
    """
    rows = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(LEFT + 1))
    fine, whole = [], []
    own = ["doc_id", "text_key", "pos", "right", "seg"]
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = rows.select(*own, F.explode(F.array(
            F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))).alias("half")
        ).select(*own, "half.lo", "half.hi").where(
            F.greatest(F.col("lo"), REPEAT - F.col("right")) <= F.least(F.col("hi") - 1, F.col("pos")))
        halves = halves.withColumn("group", F.md5(F.concat(
            F.encode(F.concat_ws(" ", "lo", "hi", F.lit("")), "utf-8"),
            F.col("seg").substr(LEFT + 1 - F.col("lo"), REPEAT + 1 - F.col("hi") + F.col("lo")))))
        large = materialize(halves.groupBy("group").count().where(F.col("count") > SPLIT_ROWS).select("group"), "large-groups")
        fine.append(halves.join(small(large), "group", "left_anti").select(F.xxhash64("group").alias("kmer"), *own))
        if large.isEmpty():
            break
        # A text's edge may cut the range of an anchor short: `first` to `last` bytes before it.
        first, last = F.greatest(F.col("lo"), REPEAT - F.col("right")), F.least(F.col("hi") - 1, F.col("pos"))
        again = halves.join(small(large), "group", "left_semi").withColumns({"first": first, "last": last}).withColumns({
            "like": F.md5(F.concat(
                F.encode(F.concat_ws(" ", "first", "last", F.lit("")), "utf-8"),
                F.col("seg").substr(LEFT + 1 - F.col("last"), REPEAT + F.col("last") - F.col("first")))),
            "own": F.xxhash64("doc_id", "text_key", "pos")})
        again = materialize(again.drop("group"), "large-anchors")
        alike = small(materialize(again.groupBy("like").agg(
            F.count("*").alias("n"), F.min("own").alias("one")).where("n > 1"), "like-anchors"))
        marked = again.join(alike, "like", "left")
        whole.append(marked.where("n IS NOT NULL").select(
            "doc_id", "text_key", (F.col("pos") - F.col("last")).cast("long").alias("start"),
            (F.col("pos") - F.col("first") + REPEAT).cast("long").alias("stop")))
        rows = marked.where("(n IS NULL OR own = one) AND hi - lo > 1").select(*own, "lo", "hi")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, fine), reduce(DataFrame.unionByName, whole) if whole else None


@arrow_udf(BinaryType())
def _squeeze(text: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t) for t in _bytes_of(text)], pa.binary())


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): stretches [start, stop) of bytes inside repeats, per document.

    A byte is covered if a string of REPEAT bytes around it, within its text, also begins
    anywhere else, in the same text or another. Documents without such bytes are not returned.
    Rows that repeat are copies of each other. Spans of one anchor are whole but may overlap
    those of another.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    anchors = materialize(base.select("doc_id", "text_key", "text").mapInArrow(
        _anchor_rows, f"kmer long, around long, doc_id {id_type}, text_key long, pos int"), "anchors")
    # Counted per task before the shuffle. The counts are stored, so that the join has nothing but
    # shuffles below it: only then does Spark split the rows of a frequent kmer.
    twice = materialize(anchors.groupBy("kmer").agg(
        F.count("*").alias("n"), (F.min("around") < F.max("around")).alias("mixed")).where("n > 1").select("kmer", "mixed"), "twice")
    shared = materialize(anchors.join(twice, "kmer").select(
        F.when(F.col("mixed"), F.col("kmer")).alias("kmer"), F.when(F.col("mixed"), F.col("around")).alias("around"),
        "doc_id", "text_key", "pos"), "shared-anchors")
    # All anchors of such a kmer have equal surroundings: each is wholly repeated.
    alike = shared.where("kmer IS NULL").select("doc_id", "text_key", "pos")
    mixed = shared.where("kmer IS NOT NULL")
    kinds = materialize(mixed.groupBy("kmer", "around").agg(
        F.count("*").alias("n"), F.min_by(F.struct("doc_id", "text_key", "pos"), F.xxhash64("doc_id", "pos")).alias("one")),
        "anchor-kinds")
    copies = mixed.join(kinds.where("n > 1").select("kmer", "around"), ["kmer", "around"]).select(
        "doc_id", "text_key", "pos")
    whole = alike.unionByName(copies).select(
        "doc_id", "text_key", F.greatest(F.col("pos") - LEFT, F.lit(0)).cast("long").alias("start"),
        (F.col("pos") + REPEAT).cast("long").alias("stop"))
    # One anchor of each kind of surroundings goes to the sorting; texts travel compressed.
    squeezed = base.select("doc_id", "text_key", _squeeze("text").alias("packed"))

    def segments_of(some: DataFrame) -> DataFrame:
        places = some.select("one.*", "kmer").groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("pos", "kmer")).alias("wanted"))  # at most a text's anchors
        return squeezed.alias("t").join(
            places.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_key") == F.col("p.text_key"))
        ).select("t.doc_id", "t.text_key", "packed", "wanted").mapInArrow(
            _segment_rows, f"kmer long, doc_id {id_type}, text_key long, pos int, right short, seg binary")

    large = materialize(kinds.groupBy("kmer").count().where(F.col("count") > SPLIT_ROWS).select("kmer"), "large-kmers")
    if large.isEmpty():
        segments = segments_of(kinds)
    else:
        cut, found = _split(materialize(segments_of(kinds.join(small(large), "kmer", "left_semi")), "large-anchors"))
        segments = segments_of(kinds.join(small(large), "kmer", "left_anti")).unionByName(cut)
        whole = whole if found is None else whole.unionByName(found)
    induced = segments.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(
        _induced_rows, f"doc_id {id_type}, text_key long, start long, stop long")
    return materialize(
        whole.unionByName(induced).groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("start", "stop")).alias("spans")), "repeated-spans")  # at most a text's anchors


def _kept(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs)."""
    if not len(start):
        return text, 0, 0
    edge = np.bincount(start, minlength=len(text) + 1) - np.bincount(np.minimum(stop, len(text)), minlength=len(text) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _all_kept(packed: pa.Array, spans: pa.Array):
    """(text, *_kept) of each row."""
    (start, stop), ends = _lists(spans)
    begin = 0
    for z, end in zip(packed.to_pylist(), ends.tolist()):
        text = zstandard.decompress(z)
        yield text, *_kept(text, start[begin:end], stop[begin:end])
        begin = end


@arrow_udf(struct_type("n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
def _digest(packed: pa.Array, spans: pa.Array) -> pa.Array:
    rows = [(len(text), removed, runs, hashlib.sha256(kept).hexdigest())
            for text, kept, removed, runs in _all_kept(packed, spans)]
    cols = list(zip(*rows)) or [[]] * 4
    return pa.StructArray.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
        ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@arrow_udf(StringType())
def _remaining(packed: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([kept.decode(errors="ignore") for _, kept, _, _ in _all_kept(packed, spans)], pa.string())


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with its text compressed and its repeated spans, and the names of the two columns."""
    packed, spans, key, d, t = (free_name(docs, n) for n in ("__packed", "__spans", "__key", "__doc", "__text"))
    found = repeated_spans(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("spans").alias(spans))
    sent = docs.withColumn(key, F.xxhash64("text")).withColumn(packed, _squeeze("text")).drop("text")
    both = sent.join(found, sent["doc_id"].eqNullSafe(found[d]) & (sent[key] == found[t]), "left")
    return both.drop(d, t, key), packed, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null is empty. Every byte of every copy of a repeated string of
    REPEAT bytes is removed, judged on the input. Texts under REPEAT bytes keep all bytes
    unless a copy elsewhere is as long. Equal rows are copies of each other. Columns besides
    doc_id and text are not read. An empty table gives no rows.
    """
    rows, packed, spans = _with_spans(docs.select("doc_id", "text"))
    return rows.select("doc_id", _digest(packed, spans).alias("__g")).select("doc_id", "__g.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` without its repeated bytes; the same rows and columns, n_chars recounted if there.

    A character of which only some bytes were removed goes whole. Null texts become empty.
    """
    rows, packed, spans = _with_spans(docs)
    out = rows.withColumn("text", _remaining(packed, spans)).drop(packed, spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
