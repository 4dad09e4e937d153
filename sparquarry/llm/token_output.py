"""Token ids in a compact binary form: static range ANS over shared frequency tables.

A table of blocks is written in the shared folder. Every block holds whole documents in
ascending order of their ids, coded on its own over interleaved lanes with one frequency
table for all blocks. Checkpoints (the lanes' states and the place in the stream) let
the parts of a block be decoded side by side, and checksums guard stream and ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, new_path, pick, sized, stored, written

#: The coder's state stays at LOW or above and gives off 32 bits at a time.
LOW, WORD_BITS = np.uint64(1 << 31), np.uint64(32)
#: Pieces of text whose ids a worker remembers; when they are more it forgets the rare ones.
REMEMBERED = 700_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 22

#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on in their order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
#: ASCII signs, but for the apostrophe: after letters, a run of them is a word of its own to a byte-level tokenizer.
SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")

_loaded: dict = {}


class PieceCoder:
    """Ids of whole texts, with the tokenizer asked once for each distinct piece.

    A byte-level tokenizer starts a new token before every space and line end that has no
    white space beside it, so the ids of a text are those of its pieces cut there. A piece
    is kept without its leading space; one that begins a line is kept with its line end.
    Texts with other white space or an added token's content go to the tokenizer whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        alone = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end, self.line_id = len(alone), alone[0]
        self.places: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.ends, self.hits = np.zeros(REMEMBERED + 1, np.int32), np.zeros(REMEMBERED + 1, np.uint8)
        parts = json.loads(tokenizer_json)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        #: Whether a space and letters are one word for the model, spelt in the byte-level alphabet.
        self.words_to_model = parts["normalizer"] is None and parts["model"]["type"] == "BPE" and (parts["pre_tokenizer"] or {}).items() >= byte_level.items()

    def ask_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of letters and then signs, each after a space, from the library's model without its splitting."""
        tokenize, space = self.tokenizer.model.tokenize, BYTE_LETTERS[32]
        found, n = [], []
        for p in pieces:
            word = p.rstrip(SIGNS)
            ids = [t.id for t in tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)))]
            if len(word) < len(p):
                ids += [t.id for t in tokenize(p[len(word) :])]
            found += ids
            n.append(len(ids))
        return np.array(found, np.uint32), np.array(n, np.int64)

    def ask(self, pieces: list[str], begin_lines: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has.

        All are asked for in one text: a line end between two comes back as an id of its own.
        """
        if self.line_end != 1:
            found = [f.ids for f in self.tokenizer.encode_batch_fast([p if begin_lines else " " + p for p in pieces], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        text = "".join(pieces) if begin_lines else "\n " + "\n ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        between = ids == self.line_id
        n = np.diff(np.append(np.flatnonzero(between), len(ids)))
        return (ids, n) if begin_lines else (ids[~between], n - 1)

    def forget(self) -> None:
        """Keep the pieces that most groups of texts had, at most half of them and none that only one had."""
        n = len(self.places)
        order = np.argsort(-self.hits[:n].astype(np.int16), kind="stable")[: n // 2]
        kept = np.sort(order[self.hits[order] > 1])
        begin, size = self.ends[kept], self.ends[kept + 1] - self.ends[kept]
        end = np.cumsum(size, dtype=np.int32)
        self.used = int(size.sum())
        self.pool[: self.used] = self.pool[np.repeat(begin - (end - size), size) + np.arange(self.used, dtype=np.int32)]
        self.ends[1 : len(kept) + 1] = end
        self.hits[: len(kept)], self.hits[len(kept) :] = self.hits[kept] // 2, 0
        names = list(self.places)
        self.places = {names[i]: at for at, i in enumerate(kept.tolist())}

    def remember(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        at = len(self.places)
        while self.used + len(ids) >= len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.ends[at + 1 : at + 1 + len(pieces)] = self.used + np.cumsum(n)
        self.used += len(ids)
        self.places.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def plain(self, text: str) -> bool:
        """Whether no added token is in the text and all white space is single spaces and line ends within it."""
        if any(t in text for t in self.added):
            return False
        if text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", " \n", "\n ", "\n\n")):
            return False
        return text.replace("\n", "").isprintable()  # no other kind of white space

    def learn(self, new: list[str]) -> None:
        words, others, lines = [], [], []
        for p in new:
            if p[:1] == "\n":
                lines.append(p)
            else:
                # Letters beyond these may be none yet to the library.
                word = p.rstrip(SIGNS)
                (words if self.words_to_model and word.isalpha() and (word.isascii() or max(word) < "\u0250") else others).append(p)
        for pieces, ask in ((words, self.ask_words), (others, lambda x: self.ask(x, False)), (lines, lambda x: self.ask(x, True))):
            if pieces:
                self.remember(pieces, *ask(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Pieces are looked up once for all texts, and the tokenizer is asked for new ones."""
        plain = [bool(t) and self.plain(t) for t in texts]
        out = [None if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), " ")
        if not len(cut):
            return out
        flat = cut.values.dictionary_encode()
        pieces = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.places) + len(missing) > len(self.ends) - 1:
                self.forget()
                at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
                missing = np.flatnonzero(at < 0)
            more = len(self.places) + len(missing) + 1 - len(self.ends)
            if more > 0:  # these texts alone need more
                self.ends, self.hits = np.append(self.ends, np.zeros(more, np.int32)), np.append(self.hits, np.zeros(more, np.uint8))
            new = [pieces[i] for i in missing.tolist()]
            self.learn(new)
            at[missing] = [self.places[p] for p in new]
        self.hits[at] += self.hits[at] < 200
        at = at[flat.indices.to_numpy()]
        begin = self.ends[at]
        n = self.ends[at + 1] - begin
        end = np.cumsum(n, dtype=np.int32)
        ids = self.pool[np.repeat(begin - (end - n), n) + np.arange(end[-1], dtype=np.int32)]
        # Every text was given a line end in front.
        parts = iter(np.split(ids, end[cut.offsets.to_numpy()[1:-1] - 1]))
        return [next(parts)[self.line_end :] if p else x for x, p in zip(out, plain, strict=True)]


def _coder(source: Broadcast) -> PieceCoder:
    key = hash(source.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCoder(source.value)
    return _loaded[key]


_RAW = "shard int, block long, doc_ids array<long>, lengths array<long>, n long, ids binary, counts binary"


def _tokenize(source: Broadcast, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, shard = _coder(source), TaskContext.get().partitionId()
        kind = "<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        held, held_ids, size, block = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            values = [shard, block, held_ids, [len(x) for x in held], size, ids.astype(kind).tobytes(), np.bincount(ids).astype("<u4").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(raw.names, values, strict=True))], raw)

        def encoded(texts: pa.Array) -> Iterator[np.ndarray]:
            some, chars = [], 0
            for t in texts:
                some.append(t.as_py() or "")
                chars += len(some[-1])
                if chars > TOGETHER:
                    yield from coder.encode(some)
                    some, chars = [], 0
            yield from coder.encode(some)

        raw = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                held_ids.append(i)
                size += len(held[-1])
                if size >= block_tokens:
                    yield closed()
                    held, held_ids, size, block = [], [], 0, block + 1
        if held:
            yield closed()

    return run


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's ids with end_id last, in blocks of whole documents in ascending order of id.

    tokenizer is the path, on the driver, of a byte-level tokenizer's file; what it holds
    (some MB) is sent to the executors. A null or empty text gives end_id alone. Rows are
    dealt out by ranges of id and sorted within: those with a null id come first, those
    that share an id are ordered by text. A block closes at the end of the document that
    fills block_tokens, so that a very long text makes one long block. Shards and their
    blocks are numbered in order.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    ordered = pick(docs, [id_col, text_col]).toDF("id", "text").repartitionByRange("id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(_tokenize(source, end_id, block_tokens), _RAW)


def _numbers(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * row["n"] else "<u4").astype("<u4")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for x in batch.column(0):
            c = np.frombuffer(x.as_py(), "<u4").astype(np.int64)
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "c"])


def scaled_frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; every symbol that occurs keeps 1 at least."""
    room, seen = 1 << bits, counts > 0
    if not seen.any():
        return counts.astype(np.uint64)
    if seen.sum() > room:
        raise ValueError(f"{seen.sum()} symbols don't fit 2**{bits}")
    f = np.where(seen, np.maximum(1, counts.astype(np.float64) / counts.sum() * room).astype(np.int64), 0)
    over = int(f.sum()) - room
    order = np.argsort(-f, kind="stable")
    while over:
        for i in order:
            step = min(over, int(f[i]) - 1, max(1, int(f[i]) // 16)) if over > 0 else over
            if f[i] > 1 or step < 0:
                f[i] -= step
                over -= step
            if not over:
                break
    return f.astype(np.uint64)


class RangeCoder:
    """Interleaved static rANS over one frequency table."""

    def __init__(self, frequencies: np.ndarray, bits: int, lanes: int = 4096, every: int = 256):
        self.f, self.bits, self.lanes, self.every = frequencies, np.uint64(bits), lanes, every
        self.cum = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))
        self.most = (frequencies * (LOW >> self.bits)) << WORD_BITS

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The stream, and the checkpoints: place in the stream and lanes' states before every part."""
        rows = -(-len(ids) // self.lanes)
        x, chunks, marks, given = np.full(self.lanes, LOW, np.uint64), [], [], 0
        for i in range(rows - 1, -1, -1):
            s = ids[i * self.lanes : (i + 1) * self.lanes]
            f, now = self.f[s], x[: len(s)]
            full = now >= self.most[s]
            if full.any():
                chunks.append(now[full].astype(np.uint32))
                given += len(chunks[-1])
                now[full] >>= WORD_BITS
            q = now // f
            now[:] = (q << self.bits) + (now - q * f) + self.cum[s]
            if i % self.every == 0:
                marks.append((given, x.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
        parts = [np.concatenate([[np.uint64(len(stream) - g)], state]) for g, state in reversed(marks)]
        return stream.astype("<u4").tobytes(), np.concatenate(parts).astype("<u8").tobytes() if parts else b""

    def decode(self, stream: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ids; all parts of the block advance together, one row each a step."""
        if not n:
            return np.empty(0, np.uint32)
        code = np.frombuffer(stream, "<u4")
        marks = np.frombuffer(checkpoints, "<u8").reshape(-1, self.lanes + 1)
        at, x = marks[:, 0].astype(np.int64), marks[:, 1:].astype(np.uint64)
        rows, mask = -(-n // self.lanes), np.uint64((1 << int(self.bits)) - 1)
        out = np.zeros((rows, self.lanes), np.uint32)
        for t in range(min(self.every, rows)):
            row = np.arange(len(at)) * self.every + t
            live = int((row < rows).sum())
            width = n - (rows - 1) * self.lanes if row[live - 1] == rows - 1 else self.lanes
            for part, w in ((slice(0, live - (width < self.lanes)), self.lanes), *(((slice(live - 1, live), width),) if width < self.lanes else ())):
                now = x[part, :w]
                if not now.size:
                    continue
                slot = now & mask
                s = self.symbol[slot]
                out[row[part], :w] = s
                now = self.f[s] * (now >> self.bits) + slot - self.cum[s]
                # Each part's next words go to its lanes that ran low, in order.
                low = now < LOW
                taken = low.sum(axis=1)
                fill = [code[a : a + k] for a, k in zip(at[part].tolist(), taken.tolist(), strict=True)]
                now[low] = (now[low] << WORD_BITS) | (fill[0] if len(fill) == 1 else np.concatenate(fill))
                x[part, :w] = now
                at[part] += taken
        return out.reshape(-1)[:n]


def _range_coder(model: Broadcast) -> RangeCoder:
    key = ("model", zlib.crc32(model.value[0].tobytes()), *model.value[1:])
    if key not in _loaded:
        for old in [k for k in _loaded if isinstance(k, tuple)]:
            del _loaded[old]
        _loaded[key] = RangeCoder(*model.value)
    return _loaded[key]


_BLOCKS = "shard int, block long, doc_ids array<long>, lengths array<long>, n long, stream binary, stream_crc32 long, checkpoints binary, ids_crc32 long"


def _encode_blocks(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _range_coder(model)
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                ids = _numbers(row)
                stream, marks = coder.encode(ids)
                coded = [pa.array([stream], pa.binary()), pa.array([zlib.crc32(marks, zlib.crc32(stream))], pa.int64()), pa.array([marks], pa.binary()), pa.array([zlib.crc32(ids.tobytes())], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:5], *coded], ["shard", "block", "doc_ids", "lengths", "n", "stream", "stream_crc32", "checkpoints", "ids_crc32"])

    return run


def write_token_file(blocks: DataFrame, path: str, bits: int = 20, lanes: int = 4096, every: int = 256) -> None:
    """Write what token_blocks gave, as path/model and path/blocks.

    The frequency table counts all ids. The driver gets one count for each id of the
    vocabulary, whatever the corpus. An empty table gives a model and no block. blocks is
    read twice, so it should be a table.
    """
    spark = blocks.sparkSession
    tally = blocks.select("counts").mapInArrow(_tally, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(1 + max((r["token"] for r in tally), default=0), np.int64)
    for r in tally:
        counts[r["token"]] = r["c"]
    frequencies = scaled_frequencies(counts, bits)
    spark.createDataFrame([(bits, lanes, every, [int(f) for f in frequencies])], "bits int, lanes int, every int, frequencies array<long>").coalesce(1).write.parquet(f"{path}/model")
    model = spark.sparkContext.broadcast((frequencies, bits, lanes, every))
    written(blocks.drop("counts").mapInArrow(_encode_blocks(model), _BLOCKS), f"{path}/blocks", compression="uncompressed")


def _read_blocks(model: Broadcast, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _range_coder(model)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["checkpoints"], zlib.crc32(r["stream"])) != r["stream_crc32"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: the stream is damaged")
                ids = memoryview(coder.decode(r["stream"], r["checkpoints"], r["n"]).astype("<u4", copy=False)).cast("B")
                if zlib.crc32(ids) != r["ids_crc32"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: the ids are damaged")
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                parts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                last = pa.array(list(map(zlib.crc32, parts)), pa.int64()) if digests else pa.array(list(map(bytes, parts)), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()), pa.array(r["lengths"], pa.int64()), last], ["id", "start", "n", "ids_crc32" if digests else "ids"])

    return run


def read_token_file(spark, path: str, digests: bool = False) -> DataFrame:
    """(id, start, n, ids) from a file that write_token_file wrote; start counts the ids of all documents before.

    Blocks are decoded on their own. Damage is an error. With digests the CRC-32 of each
    document's ids, as little-endian unsigned 32-bit numbers, comes in place of the ids.
    """
    m = spark.read.parquet(f"{path}/model").first()
    model = spark.sparkContext.broadcast((np.array(m["frequencies"], np.uint64), m["bits"], m["lanes"], m["every"]))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", "n")
    # Shards are few (one a task), so their sums can be added up in one place.
    before = sizes.groupBy("shard").agg(F.sum("n").alias("s")).select("shard", (F.sum("s").over(W.orderBy("shard")) - F.col("s")).alias("shard_start"))
    starts = sizes.withColumn("within", F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).join(before, "shard")
    starts = starts.select("shard", "block", (F.col("within") + F.col("shard_start")).alias("start"))
    placed = blocks.join(sized(stored(starts, "starts")), ["shard", "block"])
    return placed.mapInArrow(_read_blocks(model, digests), f"id long, start long, n long, {'ids_crc32 long' if digests else 'ids binary'}")


def encoded_corpus(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Write docs as a token file in the shared folder and read it back: (id, start, n, ids or ids_crc32).

    Every row counts, also with a null or repeated id, and null, empty or very long texts.
    Other columns aren't read. The file stays; its frame's folder is a new one each call.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    blocks = stored(token_blocks(docs, tokenizer, end_id, id_col=id_col, text_col=text_col), "ids", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"})
    write_token_file(blocks, path)
    discard(blocks)
    return read_token_file(spark, path, digests)
