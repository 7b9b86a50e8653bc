"""Mixture-controlled packing: deficit round-robin over one token queue per source."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from geohour.session import materialize

SEQUENCE = 1024
WINDOW_SEQUENCES = 64  # sequences of one window; each window meets the token proportions
DENSE_QUEUES = 4096  # so many queues are laid out in memory; places of more are summed by Spark
QUEUE_BLOCKS = 256  # queues of one window are summed in so many blocks, by hash
WINDOW_BLOCK = 4096  # windows, or tokens of a queue, that are summed or listed at once
END_ID = 0
VOCABULARY = "byte_bpe_50k"
CACHED_WORDS = 300_000
CHUNK_BYTES = 4 << 20  # text that is encoded at once
# White space other than single blanks and line ends between words, and special tokens.
_ODD = (r"[ \n][ \n]|^[ \n]|[ \n]$|<\||[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
        r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]")


class Encoder:
    """Token ids of texts, as the vocabulary's own tokenizer gives them.

    A blank before a word always begins a new pre-token and a single line end is one, so texts
    with only such white space are encoded word by word, each distinct word once; all other
    texts go to the tokenizer whole.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.length = np.zeros(1 << 16, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode words, those that begin with a blank in one call."""
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
        joined = [w for w in new if w[:1] == " " and len(w) > 1]
        for w in new:
            if w[:1] != " " or len(w) == 1:
                self.known[w] = np.array(self.words.encode_ordinary(w), "<u2").tobytes()
        if joined:
            ids = self.words.encode_to_numpy("".join(joined), disallowed_special=())
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in joined), np.int64, len(joined)))
            cuts = np.searchsorted(np.cumsum(self.length[ids]), ends, side="left") + 1
            raw, at = ids.astype("<u2").tobytes(), 0
            for w, cut in zip(joined, cuts.tolist()):
                self.known[w] = raw[2 * at:2 * cut]
                at = cut

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        pieces = pc.split_pattern(marked, "\0")
        coded = pieces.flatten().dictionary_encode()
        unique, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in unique if w not in self.known]
        kept = {w: self.known[w] for w in unique if w in self.known}
        self._learn(new)
        raw = [self.known[w] if w in self.known else kept[w] for w in unique]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        ids, begin = np.frombuffer(b"".join(raw), "<u2"), np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        return np.split(flat, edges[1:-1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (a string array without nulls)."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        nbytes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[plain])
        for part in np.split(plain, np.searchsorted(nbytes, np.arange(CHUNK_BYTES, (nbytes[-1] if len(nbytes) else 0), CHUNK_BYTES))):
            if len(part):
                for i, ids in zip(part.tolist(), self._plain(texts.take(pa.array(part)))):
                    out[i] = ids
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2")
        return out


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def _queue(source: str | None) -> str:
    return "" if source is None else source


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, queue, ids, n, part, before), stored: ids with END_ID at the end, in 16 bits.

    `part` is the task that read the document and `before` the tokens of its queue that the
    task read earlier; a task that runs again reads the same rows in the same order.
    """

    def run(batches):
        part, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = batch.column(2).fill_null("")
            queues = [_queue(q) for q in batch.column(1).to_pylist()]
            ids = [np.append(x, np.uint16(END_ID)) for x in encoder(vocabulary).encode(texts)]
            before = []
            for q, x in zip(queues, ids):
                before.append(used.get(q, 0))
                used[q] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(queues, pa.string()), pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([len(x) for x in ids], pa.int64()), pa.array([part] * len(ids), pa.int64()),
                pa.array(before, pa.int64())], ["doc_id", "queue", "ids", "n", "part", "before"])

    made = docs.select("doc_id", "source", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, queue string, ids binary, "
             "n long, part long, before long")
    return materialize(made, "tokens")


@dataclass
class Rounds:
    """The round-robin in closed form.

    One window is one round. A round credits queue s with the share w_s / sum(w) of the window
    among the queues that still hold tokens; the queue serves the whole tokens of its credit,
    cutting documents freely, and the deficit, a part of a token, is carried to the next
    window. So after r windows queue s has served min(c_s, floor(w_s v_r)) tokens, where v_r
    is the time at which the queues together have served r windows. As this is a function of r
    alone, each task lays out its own documents with the deficits of all windows before them.

    Queues without a target weigh their own tokens, so they run dry together and count as one
    here: only the queues that `targets` names are listed, whatever the number of queues.
    """

    total: int  # tokens of all queues
    window: int
    targets: dict[str, float]
    named: dict[str, int]  # tokens of the queues that have a target

    def __post_init__(self):
        counts = np.array([*self.named.values(), self.total - sum(self.named.values())], np.int64)
        weights = np.append(self.weight(list(self.named), counts[:-1]), counts[-1] / self._unit())
        counts, weights = counts[counts > 0], weights[counts > 0]
        dry = counts / weights  # when each queue runs dry
        order = np.argsort(dry, kind="stable")
        self.dry = dry[order]
        gone = np.concatenate([[0], np.cumsum(counts[order])])
        rate = np.concatenate([np.cumsum(weights[order][::-1])[::-1], [0]])
        self.at = gone[:-1] + self.dry * rate[:-1]  # tokens served when each runs dry
        self.gone, self.rate = gone, rate

    def _unit(self) -> float:
        """What the tokens of a queue without a target are divided by: weights are shares if any has one."""
        return float(self.total) if self.targets else 1.0

    def weight(self, queues: list[str], counts: np.ndarray) -> np.ndarray:
        own = counts / self._unit()
        if not self.targets:
            return own
        return np.array([max(self.targets[q], 1e-12) if q in self.targets else w for q, w in zip(queues, own)], float)

    def time(self, served: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, served, side="left")
        k = np.minimum(k, len(self.dry) - 1)
        return (served - self.gone[k]) / self.rate[k]

    def served(self, count: np.ndarray, weight: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Tokens that queues of so many tokens and such weights have served before `window`."""
        start = window.astype(np.float64) * self.window
        got = np.floor(weight * self.time(start)).astype(np.int64)
        got = np.where(start >= self.total, count, np.minimum(got, count))
        return np.where(window <= 0, 0, got)

    def window_of(self, count: np.ndarray, weight: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window in which a queue serves its token of this number."""
        time = token / weight
        k = np.searchsorted(self.dry, time, side="left")
        k = np.minimum(k, len(self.dry) - 1)
        guess = ((self.gone[k] + time * self.rate[k]) // self.window).astype(np.int64)
        for _ in range(64):  # rounding moves a guess by a window at most
            low = self.served(count, weight, guess) > token
            high = self.served(count, weight, guess + 1) <= token
            if not (low | high).any():
                break
            guess = guess - low + high
        return guess


def _block(queue: str = "queue") -> Column:
    return F.pmod(F.xxhash64(queue), F.lit(QUEUE_BLOCKS))


def _places(queues: DataFrame, rounds: Rounds) -> DataFrame:
    """(queue, window, place): where each queue's tokens of each window begin in the output.

    Only windows in which the queue serves a token have a row, so there are no more rows than
    pieces of documents. Places are running sums over windows and, inside each, over blocks of
    queues and the queues of a block; no task sums more than a block.
    """
    windows = -(-rounds.total // rounds.window)

    def run(batches):
        for batch in batches:
            names, counts, steps = (batch.column(i).to_pylist() for i in range(3))
            weights = rounds.weight(names, np.array(counts, np.int64))
            out = []
            for q, c, step, weight in zip(names, counts, steps, weights):
                def whole(x):
                    return np.full(len(x), c), np.full(len(x), weight)

                at = np.arange(step * WINDOW_BLOCK, min((step + 1) * WINDOW_BLOCK, windows if c > windows else c))
                if c <= windows:  # few tokens: the windows of each, if not that of the token before
                    near = np.concatenate([at[:1] - 1, at])
                    w = rounds.window_of(*whole(near), np.maximum(near, 0))
                    at = w[1:][(w[1:] != w[:-1]) | (near[1:] == 0)]
                size = rounds.served(*whole(at), at + 1) - rounds.served(*whole(at), at)
                at, size = at[size > 0], size[size > 0]
                out.append((np.full(len(at), q, object), at, size))
                if sum(len(o[1]) for o in out) >= 16 * WINDOW_BLOCK:
                    yield _spans(out)
                    out = []
            if out:
                yield _spans(out)

    def _spans(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[0] for o in out]), pa.string()), *(
                pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in (1, 2))], ["queue", "window", "size"])

    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(
        (F.least(F.col("n"), F.lit(windows)) - 1) / WINDOW_BLOCK).cast("long"))).alias("step")
    spans = materialize(
        queues.select("queue", "n", steps).repartition("queue", "step").mapInArrow(
            run, "queue string, window long, size long").withColumn("block", _block()), "queue-windows")
    blocks = spans.groupBy("window", "block").agg(F.sum("size").alias("size"))
    wide = materialize(spans.groupBy("window").agg(F.sum("size").alias("size")).withColumn(
        "group", F.floor(F.col("window") / WINDOW_BLOCK)), "window-sums")
    groups = _running(wide.groupBy("group").agg(F.sum("size").alias("size")), [], "group", "far").drop("size")
    starts = _running(wide, ["group"], "window", "near").join(groups, "group").select("window", "far", "near")
    ahead = _running(blocks, ["window"], "block", "ahead").drop("size").join(starts, "window")
    return _running(spans, ["window", "block"], "queue", "own").join(ahead, ["window", "block"]).select(
        "queue", "window", (F.col("far") + F.col("near") + F.col("ahead") + F.col("own")).alias("place"))


def _running(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """`rows` and the sum of `size` over the rows before, as `name`."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum("size").over(over), F.lit(0)))


_CUT = ["doc_id", "doc_tokens", "queue", "window", "start", "skip", "ids"]


def _cut(batch: pa.RecordBatch, rounds: Rounds) -> tuple[list, list[np.ndarray]]:
    """Documents cut at windows: (doc_id, doc_tokens, queue) columns, and arrays (document, window, its first token
    in the document, tokens, tokens of the queue's part of the window before it)."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    n = col["n"].to_numpy()
    first = col["before"].to_numpy() + col["base"].to_numpy()
    count = col["total"].to_numpy()
    weight = rounds.weight(col["queue"].to_pylist(), count)
    w0, w1 = rounds.window_of(count, weight, first), rounds.window_of(count, weight, first + n - 1)
    size = w1 - w0 + 1
    row = np.repeat(np.arange(len(n)), size)
    w = w0[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    low = rounds.served(count[row], weight[row], w)
    a = np.maximum(first[row], low)
    b = np.minimum(first[row] + n[row], rounds.served(count[row], weight[row], w + 1))
    has = b > a
    row, w, low, a, b = row[has], w[has], low[has], a[has], b[has]
    return [col["doc_id"], col["n"], col["queue"]], [row, w, a - first[row], b - a, a - low]


def _lay(docs: list, row, w, start, length, pos, raw, skip, sequence: int) -> pa.RecordBatch:
    """Output rows of pieces that begin at `pos`; their ids begin `skip` tokens into raw[row]."""
    s0, s1 = pos // sequence, (pos + length - 1) // sequence
    size = s1 - s0 + 1
    piece = np.repeat(np.arange(len(row)), size)
    s = s0[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    begin = np.maximum(pos[piece], s * sequence)
    end = np.minimum(pos[piece] + length[piece], (s + 1) * sequence)
    doc = row[piece]
    ahead, length = begin - pos[piece], end - begin
    crc, now, wide = np.empty(len(doc), np.int64), -1, b""
    for i, (d, x, m) in enumerate(zip(doc.tolist(), (skip[piece] + ahead).tolist(), length.tolist())):
        if d != now:
            now, wide = d, memoryview(np.frombuffer(raw[d].as_buffer(), "<u2").astype("<u4").tobytes())
        crc[i] = zlib.crc32(wide[4 * x:4 * (x + m)])
    take = pa.array(doc)
    doc_id, n, queue = docs
    return pa.RecordBatch.from_arrays([
        doc_id.take(take), pa.array(start[piece] + ahead), pa.array(length), pa.array(crc), n.take(take), pa.array(s),
        pa.array(begin - s * sequence), queue.take(take), pa.array(w[piece])],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE,
         window_sequences: int = WINDOW_SEQUENCES, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece of a document; all tokens of all documents are packed.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (the
    queue) and window. A window is `window_sequences` full sequences; each takes from every
    source the tokens of its target proportion, up to one token that is carried as deficit.
    `targets` gives weights by source; sources that it lacks, and all without it, weigh their
    own tokens, so all queues end together. A queue that runs dry leaves its share to the
    others. Windows lie end to end, so only the very last sequence is shorter than `sequence`.

    Null and empty texts are their END_ID alone; null and empty sources are one queue. Every
    source has its own queue, however many there are: beyond DENSE_QUEUES their places are
    summed by Spark and documents travel cut at windows, with the same result. Equal rows are
    packed each for itself; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, vocabulary)
    sums = materialize(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "queue-sums")
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("queue")
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"),
                        F.sum("n").over(every).alias("total"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, "
              "doc_tokens long, sequence_id long, offset long, source string, window long")
    queues = materialize(sums.groupBy("queue").agg(F.sum("n").alias("n")), "queues")
    known, total = queues.agg(F.count("*"), F.sum("n")).first()
    if not known:
        return spark.createDataFrame([], schema)
    targets = targets or {}
    named = {}
    if targets:  # only queues that the caller's dict names come to the driver
        wanted = spark.createDataFrame([(q,) for q in targets], "queue string")
        named = {r.queue: r.n for r in queues.join(F.broadcast(wanted), "queue").orderBy("queue").collect()}
    rounds = Rounds(total, sequence * window_sequences, targets, named)
    placed = tokens.join(bases, ["queue", "part"])
    if known <= DENSE_QUEUES:
        rows = queues.orderBy(_block(), "queue").collect()  # at most DENSE_QUEUES
        names, counts = [r.queue for r in rows], np.array([r.n for r in rows], np.int64)
        weights, number = rounds.weight(names, counts), {q: i for i, q in enumerate(names)}

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols, (row, w, start, length, skip) = _cut(batch, rounds)
                unique, of = np.unique(w, return_inverse=True)
                now = rounds.served(counts[None, :], weights[None, :], unique[:, None])
                size = rounds.served(counts[None, :], weights[None, :], unique[:, None] + 1) - now
                place = now.sum(axis=1)[:, None] + np.cumsum(size, axis=1) - size
                q = np.array([number[x] for x in cols[2].to_pylist()])
                yield _lay(cols, row, w, start, length, place[of, q[row]] + skip,
                           batch.column(batch.schema.get_field_index("ids")), start, sequence)

        return placed.mapInArrow(run, schema)

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, (row, w, start, length, skip) = _cut(batch, rounds)
            raw = [x.as_py() for x in batch.column(batch.schema.get_field_index("ids"))]
            ids = [raw[r][2 * x:2 * (x + m)] for r, x, m in zip(row.tolist(), start.tolist(), length.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in cols), pa.array(w), pa.array(start), pa.array(skip), pa.array(ids, pa.binary())], _CUT)

    def lay(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = np.array([len(x.as_buffer()) // 2 for x in col["ids"]], np.int64)
            row = np.arange(batch.num_rows)
            yield _lay([col["doc_id"], col["doc_tokens"], col["queue"]], row, col["window"].to_numpy(), col["start"].to_numpy(),
                       length, col["place"].to_numpy() + col["skip"].to_numpy(), col["ids"], 0 * row, sequence)

    pieces = placed.mapInArrow(
        cut, f"doc_id {id_type}, doc_tokens long, queue string, window long, start long, skip long, ids binary")
    return pieces.join(_places(queues, rounds), ["queue", "window"]).select(*_CUT, "place").mapInArrow(lay, schema)
