"""Fill-in-the-middle: texts cut at units into prefix, middle and suffix, found by word-wide bit tricks."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from geohour.llm.common import struct_type

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED, RATE, SPM_RATE = 7, 100, 50

# Eight bytes of text are one unsigned word; these hold the same byte eight times.
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_SEVEN, _EIGHT, _ONE = np.uint64(7), np.uint64(8), np.uint64(1)

RESULT = struct_type("n long, form string, output string, prefix_chars long, middle_chars long")


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words; the last one is filled up with zeros."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)  # one word more, so every end has a word
    padded[:len(data)] = data
    return padded.view("<u8")


def byte_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """Bit 7 of every byte that equals `byte`; no borrow runs into the next byte."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """Bit 7 of every byte 10xxxxxx, which begins no code point."""
    return words & _HIGH & ~(words << _ONE)


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)  # marks before each word
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before the byte positions `at`."""
        word = at >> 3
        below = (_ONE << ((at & 7).astype(np.uint64) * _EIGHT)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte positions of the k-th marks, counted from 0.

        The running counts tell the word. In it, one multiplication sums the marks up to each
        byte, and the bytes whose sum does not exceed the wanted place come before the mark.
        """
        word = np.searchsorted(self.before, k, side="right") - 1
        place = (k - self.before[word]).astype(np.uint64)
        sums = (self.marks[word] >> _SEVEN) * _ONES
        not_after = ((place * _ONES | _HIGH) - sums) & _HIGH
        return word * 8 + np.bitwise_count(not_after)


class Cutter:
    """The texts of a batch, back to back, with their units (lines with their line break)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        """`ends` has the place at which the first text begins, 0, and then the end of each text."""
        self.start, self.stop = ends[:-1], ends[1:]
        words = words_of(data)
        marks = byte_marks(words, 0x0A)
        last = self.stop[self.stop > self.start] - 1  # the last byte of a text ends a unit too
        np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _EIGHT))
        self.units, self.inner = Marks(marks), Marks(continuation_marks(words))
        self.first = self.units.rank(self.start)
        self.n = self.units.rank(self.stop) - self.first

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte after so many units of each text."""
        some = units > 0
        at = self.start.copy()
        at[some] = self.units.select(self.first[some] + units[some] - 1) + 1
        return at

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points from byte a to byte b."""
        return b - a - (self.inner.rank(b) - self.inner.rank(a))


def draws(seed: int, ids: list[str | None]) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{i or ''}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def arrange(ids: pa.Array, text: pa.Array, seed: int, rate: int, spm_rate: int, sentinels=SENTINELS) -> pa.Array:
    """RESULT of one batch of texts."""
    text = text.fill_null("")
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    held = text.buffers()[2]
    size = int(ends[-1] - ends[0])
    data = np.frombuffer(held, np.uint8, size, int(ends[0])) if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    cutter, h = Cutter(data, ends), draws(seed, ids.to_pylist())
    one, two = h[:, 0] % (cutter.n + 1), h[:, 1] % (cutter.n + 1)
    a, b = cutter.after(np.minimum(one, two)), cutter.after(np.maximum(one, two))
    plain = (ends[1:] == ends[:-1]) | (h[:, 2] % 100 >= rate)
    for s in sentinels:
        plain |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
    spm = h[:, 3] % 100 < spm_rate
    p, s, m = (x.encode() for x in sentinels)
    raw, out = memoryview(data), []
    for i, (at, x, y, to) in enumerate(zip(ends[:-1].tolist(), a.tolist(), b.tolist(), ends[1:].tolist())):
        if plain[i]:
            out.append(bytes(raw[at:to]))
        elif spm[i]:
            out.append(b"".join((s, raw[y:to], p, raw[at:x], m, raw[x:y])))
        else:
            out.append(b"".join((p, raw[at:x], s, raw[y:to], m, raw[x:y])))
    return pa.StructArray.from_arrays([
        pa.array(cutter.n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
        pa.array(out, pa.binary()).view(pa.string()),
        pa.array(cutter.chars(cutter.start, a), mask=plain), pa.array(cutter.chars(a, b), mask=plain),
    ], names=RESULT.names)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim", *, seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of `docs` with a column `out`: n, form, output, prefix_chars, middle_chars.

    A text has n lines, each with its line break. The hash of `<seed>:<id>` draws two places
    between lines, which cut it into prefix, middle and suffix, and the form: `psm` and `spm`
    put the middle last, behind the sentinels, `rate` per cent of the texts get one of them, and
    `spm_rate` of these the form spm. Empty and null texts and texts that contain a sentinel
    stay `plain`, with null lengths. `restored` turns an output back into its text.

    Texts are read whole, at any length, in Arrow batches bounded by bytes; one row is one text,
    and nothing is shuffled. Rows that repeat are all returned, with equal results; a null id
    draws as an empty one, so all texts without an id share their draws. Extra columns stay; a
    column named as `out` is replaced. An empty table gives no rows.
    """
    first = sentinels[0][:1]
    if any(x.count(first) != 1 or not x.startswith(first) for x in sentinels) or any(
            x.startswith(y) for x, y in permutations(sentinels, 2)):
        raise ValueError("sentinels must begin with one character that they hold only there, and none with another")

    @arrow_udf(RESULT)
    def arranged(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return arrange(ids, texts, seed, rate, spm_rate, sentinels)

    return docs.withColumn(out, arranged(F.col(doc_id).cast("string"), F.col(text)))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of; no sentinel lies in it or across its cuts."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(a: Column, b: Column) -> Column:
        return F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))

    middle = F.split_part(output, m, F.lit(2))
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
