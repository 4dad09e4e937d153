"""Near-duplicate documents by SimHash, found with the general pigeonhole principle.

A fingerprint bit is the majority of that bit in the hashes of all shingles. To find all
fingerprints within t bits of another, its bits are put into parts, bits that go together
into the same one, and each part gets a threshold of its own, -1 for a part that isn't
searched. If thresholds add up to t - parts + 1, two fingerprints within t bits are within
its threshold in some part. Which thresholds cost least depends on the fingerprint: they
are allocated by dynamic programming over estimates of what each part would give. Then
every value within a part's threshold is looked up, and what is found is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, sized, stored
from .components import connected_components

SEED = 42
BITS = 64
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 14
#: Bits of the values whose frequencies the estimates are made of.
SLICE = 8


def fingerprint(text: bytes, k: int) -> int:
    """The majority bits of XXH64 of a text's k-word shingles, repeats included, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(k, len(words)) - 1 :]
    counts, total, hashed = np.zeros(BITS, np.int64), len(ends), xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), k) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    return run


def _as_bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits a and b are set together."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        x = _as_bits(batch.column(0).to_numpy()).astype(np.float32)
        total += x.T @ x
    a, b = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b].astype(np.int64))], ["a", "b", "c"])


def grouped_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in parts of nearly equal width: each grown from the bit that goes with the others most, by the bit that goes with it most.

    counts: how often two bits of n fingerprints are set together.
    """
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - i)
        part = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (tie[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits as one small number."""
    u = fp.view(np.uint64)
    return sum((((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(j) for j, b in enumerate(bits)), np.zeros(len(u), np.uint64)).astype(np.int64)


def _slices(parts: list[list[int]]) -> list[tuple[int, list[int]]]:
    return [(i, part[at : at + SLICE]) for i, part in enumerate(parts) for at in range(0, len(part), SLICE)]


def _frequencies(parts: list[list[int]]):
    cut = _slices(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cut), 1 << SLICE), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for s, (_, bits) in enumerate(cut):
                total[s] += np.bincount(_values(fp, bits), minlength=1 << SLICE)
        s, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(total[s, v])], ["s", "v", "c"])

    return run


class Allocation:
    """Thresholds by fingerprint. frequencies: of each slice's values; frequent: by part, how many fingerprints share a frequent value."""

    def __init__(self, parts: list[list[int]], frequencies: np.ndarray, n: int, most: int, frequent: dict[tuple[int, int], int], probe_cost: float = 2.0):
        self.parts, self.most, self.n, self.probe_cost = parts, most, n, probe_cost
        apart = np.bitwise_count(np.arange(1 << SLICE, dtype=np.uint16)[:, None] ^ np.arange(1 << SLICE, dtype=np.uint16)[None, :])
        share = frequencies / np.maximum(frequencies.sum(axis=1, keepdims=True), 1)
        #: By slice and value: the share of fingerprints whose value is 0, 1, ... bits away.
        self.near = np.stack([[(apart == d) @ f for d in range(most + 1)] for f in share]).transpose(0, 2, 1)
        self.masks = [np.uint64(sum(1 << b for b in part)).astype(np.uint64).view(np.int64) for part in parts]
        self.frequent = []
        for i in range(len(parts)):
            keys = np.array(sorted(k for p, k in frequent if p == i), np.int64)
            self.frequent.append((keys, np.array([frequent[i, int(k)] for k in keys], np.float64)))

    def estimates(self, fp: np.ndarray) -> np.ndarray:
        """(row, part, d): about how many fingerprints are within d bits in that part; slices count as independent, frequent values are known."""
        out = np.zeros((len(fp), len(self.parts), self.most + 1))
        out[:, :, 0] = 1
        for s, (i, bits) in enumerate(_slices(self.parts)):
            p, before = self.near[s][_values(fp, bits)], out[:, i].copy()
            out[:, i] = sum(np.pad(before, ((0, 0), (d, 0)))[:, : self.most + 1] * p[:, d : d + 1] for d in range(self.most + 1))
        out = np.cumsum(out, axis=2) * self.n
        for i, (keys, c) in enumerate(self.frequent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, fp & self.masks[i]), len(keys) - 1)
                out[:, i] = np.maximum(out[:, i], np.where(keys[at] == (fp & self.masks[i]), c[at], 0)[:, None])
        return out

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(row, part): thresholds from -1 on, of the least estimated cost, that add up to most - parts + 1."""
        found, units = self.estimates(fp), self.most + 1
        rows, m = len(fp), len(self.parts)
        cost = np.zeros((rows, m, units + 1))
        for i, part in enumerate(self.parts):
            cost[:, i, 1:] = found[:, i] + self.probe_cost * np.cumsum([len(list(combinations(part, d))) for d in range(units)])
        # best[:, u]: the least cost of giving u units, one for each threshold from 0 on, to the parts so far.
        best, picks = np.where(np.arange(units + 1) == 0, 0.0, np.inf)[None].repeat(rows, 0), []
        for i in range(m):
            each = np.stack([np.pad(best, ((0, 0), (u, 0)), constant_values=np.inf)[:, : units + 1] + cost[:, i, u : u + 1] for u in range(units + 1)])
            picks.append(each.argmin(axis=0))
            best = each.min(axis=0)
        out, left = np.zeros((rows, m), np.int64), np.full(rows, units)
        for i in range(m - 1, -1, -1):
            out[:, i] = picks[i][np.arange(rows), left]
            left -= out[:, i]
        return out - 1


def _probes(allocation: Allocation):
    """A row for each value to look up, and with part value and fingerprint the same for what is looked up."""
    flips = [[np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(part, d)], np.uint64).view(np.int64) for t in range(allocation.most + 1)] for part in allocation.parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), 1000):
                fp = every[at : at + 1000]
                t = allocation.thresholds(fp)
                for i, mask in enumerate(allocation.masks):
                    for most in range(allocation.most + 1):
                        q = fp[t[:, i] == most]
                        keys = ((q & mask)[:, None] ^ flips[i][most][None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(np.repeat(q, len(flips[i][most])))], ["part", "key", "q"])

    return run


def links_within(fps: DataFrame, most: int = 2, parts: int | None = None, hot: int = 1000) -> DataFrame:
    """(q, fp), q > fp: all pairs of the distinct numbers in fps (a stored table of one long column, fp) at most so many bits apart.

    parts: of how many bits a part has is decided by how many numbers there are, so that a value
    of a part is expected about once, if it isn't given. A value that more than hot numbers share is
    cut further: those that agree in a part to within most bits agree in one of most + 1 pieces of
    the rest, so that such a group is never paired as a whole.
    """
    n = fps.count()
    parts = parts or max(2, min(4, BITS // max(1, (n - 1).bit_length()))) if n else 2
    counts = np.zeros((BITS, BITS))
    for r in fps.mapInArrow(_together, "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).collect():
        counts[r["a"], r["b"]] = counts[r["b"], r["a"]] = r["c"]
    groups = grouped_bits(counts, n, parts)
    frequencies = np.zeros((len(_slices(groups)), 1 << SLICE))
    for r in fps.mapInArrow(_frequencies(groups), "s int, v int, c long").groupBy("s", "v").agg(F.sum("c").alias("c")).collect():
        frequencies[r["s"], r["v"]] = r["c"]

    masks = [int(np.uint64(sum(1 << b for b in g)).astype(np.uint64).view(np.int64)) for g in groups]
    index = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("at"), "fp").select("at.part", "at.key", "fp")
    shared = stored(index.groupBy("part", "key").agg(F.count("*").alias("c")).where(F.col("c") > hot), "shared")
    # Values of a thousandth of all: a thousand a part at most.
    frequent = {(r["part"], r["key"]): r["c"] for r in shared.where(F.col("c") * 1000 >= n).collect()}
    allocation = Allocation(groups, frequencies, n, most, frequent)
    probes = fps.mapInArrow(_probes(allocation), "part int, key long, q long")

    # The rest of a frequent value's bits in pieces: which, and their value.
    pieces = [[int(np.uint64(sum(1 << b for b in rest[j :: most + 1])).astype(np.uint64).view(np.int64)) for j in range(most + 1)] for rest in ([b for b in range(BITS) if b not in g] for g in groups)]
    of_part = F.array(*[F.array(*[F.lit(m) for m in p]) for p in pieces])

    def cut(df: DataFrame, number: str) -> DataFrame:
        """df with piece and value; rows of a frequent value once for each piece."""
        marked = df.join(sized(shared.select("part", "key", F.lit(True).alias("hot"))), ["part", "key"], "left")
        each = F.transform(F.element_at(of_part, F.col("part") + 1), lambda m, j: F.struct(j.alias("piece"), F.col(number).bitwiseAND(m).alias("value")))
        one = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("value")))
        return marked.withColumn("cut", F.explode(F.when(F.col("hot"), each).otherwise(one))).select("part", "key", "cut.piece", "cut.value", number)

    met = cut(probes, "q").join(cut(index, "fp"), ["part", "key", "piece", "value"])
    return met.where((F.col("q") > F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= most)).select("q", "fp").distinct()


def simhash_near_duplicates(docs: DataFrame, shingle_words: int = 3, most: int = 2, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id, kept.

    Two documents are linked if their fingerprints differ in at most so many bits. component_id is
    the smallest id that links reach; kept marks the row that has it. No pair is missed: see
    links_within(). Equal fingerprints are one vertex.

    A null or blank text has fingerprint 0 and is linked by it; a text of fewer words than a shingle
    is one shingle. Rows that share an id belong together, as do all that any of them is linked with. A
    row with a null id has a fingerprint, links with nothing, has a null component_id and is kept. Only id
    and text are read. An empty table gives an empty result. What is shuffled of a text is its id and
    fingerprint.
    """
    read = pick(docs, [id_col, text_col]).toDF("id", "text")
    signed = stored(read.mapInArrow(_fingerprints(shingle_words), "id long, fp long"), "fingerprints")
    usable = signed.where("id is not null")
    alike = stored(usable.groupBy("fp").agg(F.min("id").alias("rep")), "alike")
    only = stored(alike.select("fp"), "distinct")
    several = usable.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("id", "lo")
    tied = usable.join(several, "id").where("fp <> lo").select(F.col("fp").alias("q"), F.col("lo").alias("fp"))
    links = stored(links_within(only, most, parts).union(tied), "links")
    label = stored(connected_components(links), "labels")

    own = alike.select(F.col("fp").alias("node"), "rep").join(label, "node")
    least = own.join(own.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("fp"), "least")
    named = stored(alike.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("least")), "named")
    discard(links, label, only, alike)
    out = signed.join(sized(named), "fp", "left")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
