"""Fill-in-the-middle: texts cut at line ends in three, with the middle moved last.

A rolling hash over the bytes cuts a text into chunks that depend on nearby content only,
so texts that share passages share chunks. Each worker remembers what it has learned of a
chunk: line ends, characters, and whether the chunk ends a line. Adding these up over a
text's chunks gives its number of lines and the chunk that holds a cut; only that chunk
is searched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: One number for each byte; a window's hash is the sum of its bytes' numbers, each shifted left by its distance to the end.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], np.uint32)
#: Bytes in the window, bits that are zero where a chunk ends, bytes of the shortest and longest chunk.
WINDOW, ZEROS, SHORTEST, LONGEST = 32, 9, 64, 8192
#: Bytes hashed at a time, and given to Spark at a time.
SEGMENT, TOGETHER = 1 << 20, 16 << 20


class Summary(NamedTuple):
    """Of a chunk: its line ends, the characters that begin in it, and whether its last byte ends a line."""

    line_ends: int
    chars: int
    closed: bool


def _starts(data: np.ndarray) -> int:
    """Characters that begin in UTF-8 bytes: all bytes but continuations."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def summary(chunk: bytes) -> Summary:
    return Summary(chunk.count(b"\n"), _starts(np.frombuffer(chunk, np.uint8)), chunk.endswith(b"\n"))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes that end at each byte (fewer at the start)."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end; the last is the text's end."""
    wanted = []
    for at in range(0, len(data), SEGMENT):
        back = min(at, WINDOW - 1)
        h = window_hashes(data[at - back : at + SEGMENT])[back:]
        wanted.append(np.flatnonzero(h >> np.uint32(32 - ZEROS) == 0) + at + 1)
    ends, last = np.concatenate(wanted) if wanted else np.empty(0, np.int64), 0
    out: list[int] = []
    while len(data) - last > SHORTEST:
        i = int(np.searchsorted(ends, last + SHORTEST))
        last = min(int(ends[i]) if i < len(ends) else len(data), last + LONGEST, len(data))
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


class Memo:
    """Summaries by chunk: looked up by hash, held against the content, as a dict does; those long unused go.

    Holds at most 2 * most bytes of chunks.
    """

    def __init__(self, most: int = 16 << 20):
        self.most, self.size, self.young, self.old = most, 0, {}, {}
        self.found = self.made = 0

    def __call__(self, chunk: bytes) -> Summary:
        known = self.young.get(chunk)
        if known is not None:
            self.found += 1
            return known
        known = self.old.get(chunk)
        self.found += known is not None
        self.made += known is None
        known = known or summary(chunk)
        if self.size + len(chunk) > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[chunk] = known
        self.size += len(chunk)
        return known


class Lines:
    """A text's line ends, found by way of its chunks."""

    def __init__(self, data: bytes, memo: Memo):
        self.data = data
        self.ends = chunk_ends(np.frombuffer(data, np.uint8))
        self.begins = [0, *self.ends[:-1]]
        known = [memo(data[a:b]) for a, b in zip(self.begins, self.ends, strict=False)]
        self.upto = list(accumulate(k.line_ends for k in known))
        self.chars = [0, *accumulate(k.chars for k in known)]
        #: Lines, the last with or without an end.
        self.n = (self.upto[-1] + (not known[-1].closed)) if known else 0

    def after(self, k: int) -> tuple[int, int]:
        """(byte, character) at which the first k lines end."""
        if k == 0:
            return 0, 0
        if k == self.n:
            return len(self.data), self.chars[-1]
        i = bisect_left(self.upto, k)
        begin = self.begins[i]
        chunk = np.frombuffer(self.data, np.uint8, self.ends[i] - begin, begin)
        end = int(np.flatnonzero(chunk == 10)[k - 1 - (self.upto[i - 1] if i else 0)]) + 1
        return begin + end, self.chars[i] + _starts(chunk[:end])


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            rows, size = [], 0
            for i, text, h in zip(batch.column(0), batch.column(1), zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True), strict=True):
                data = (text.as_buffer() or pa.py_buffer(b"")).to_pybytes() if text.is_valid else b""
                lines = Lines(data, memo)
                if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h[2] % 100 >= rate:
                    row = (lines.n, "plain", None, None, data)
                else:
                    first, second = sorted((h[0] % (lines.n + 1), h[1] % (lines.n + 1)))
                    (a, a_chars), (b, b_chars) = lines.after(first), lines.after(second)
                    form = "spm" if h[3] % 100 < spm else "psm"
                    order = (SUFFIX, data[b:], PREFIX, data[:a]) if form == "spm" else (PREFIX, data[:a], SUFFIX, data[b:])
                    row = (lines.n, form, a_chars, b_chars - a_chars, b"".join((*order, MIDDLE, data[a:b])))
                rows.append((i.as_py(), *row))
                size += len(data)
                if size > TOGETHER:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:5], columns[5].cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(seed: int, identity: Column) -> list[Column]:
    """Four numbers below 2**32 from a row's id: the first groups of a sha256's hex digits. A null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n (lines), form, prefix_chars, middle_chars, output.

    Of rows, rate per cent are cut after two of their lines, drawn by id, and of those spm
    per cent put the suffix before the prefix: `<S>`suffix`<P>`prefix`<M>`middle, form spm;
    else `<P>`prefix`<S>`suffix`<M>`middle, form psm. All others are plain: output is the text.
    Texts that hold one of the three marks stay plain, so that restored_text() is exact.

    A null text is taken as empty; an empty text has no lines and is plain. Rows that share an
    id get the same draws, each for its own lines; null ids share one. Other columns aren't
    read. An empty table gives an empty result. Every row is treated on its own, without a
    shuffle; a worker remembers 32 MB of chunks at most, hashes long texts piece by piece,
    and what it remembers changes the speed alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    read = pick(rows, ["id", "text"]).select("id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col("id")))])
    out = read.mapInArrow(_transform(rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.element_at(parts, i)  # noqa: E731  parts[0] is before the first mark
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)
