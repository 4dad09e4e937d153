"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components.

Copies with one shingle set collapse to one vertex first. Each set gets a
signature from two permutations of 2**32: the first shuffles the elements, the second
is applied after a circular shift by k for coordinate k. Sets that agree on a band meet
in a bucket. A bucket is never expanded into all its pairs: it is dealt into small slots,
whose first member is compared with the others. Most buckets then are of one component.
Documents of the others are compared exactly, by a join on their rarest shingles, with
all that isn't in their component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, stored
from .components import connected_components

#: Elements hashed at a time, so that a block of coordinates stays in cache.
BLOCK = 1024


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased.

    With fewer than k words the whole sequence is one shingle; without words: empty.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(k, len(found))
    acc = np.full(len(h) - width + 1, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(width):
        acc = (acc ^ h[i : len(h) - width + 1 + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _permute(x: np.ndarray, odd1: int, odd2: int) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(odd1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(odd2)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least value of the second permutation, shifted by k, over the permuted set."""
    first = _permute((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), BLOCK):
        np.minimum(out, _permute(first[None, at : at + BLOCK] - shift, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows.shape[1]):
        key = (key ^ rows[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(circulant_signature(s, bands * rows), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "version", "n", "digest", "bands"],
            )

    return run


def _compare(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            shared, both = [], []
            for a, x, y in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                if last is None or a.as_py() != last:
                    last, first = a.as_py(), shingle_set(x.as_py(), k)
                other = shingle_set(y.as_py(), k)
                n = len(np.intersect1d(first, other, assume_unique=True))
                shared.append(n)
                both.append(len(first) + len(other) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "shared", "total"])

    return run


def _measured(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) with whether their whole sets are similar enough: a table."""
    held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    held = held.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    out = held.mapInArrow(_compare(k), "a long, b long, shared long, total long")
    return stored(out.select("a", "b", (100 * F.col("shared") >= percent * F.col("total")).alias("similar")), "compared")


def _fits(percent: int):
    """Sets whose sizes are further apart can't be similar enough."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), k).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _rare_pairs(texts: DataFrame, parts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar enough; no pair that is gets lost.

    parts: id, component. Similar sets share one of the first n - need + 1 of their n
    shingles in any order, here from rare to frequent, and from the first shared one on
    enough must be left in both. Per shingle, the members of its largest component aren't
    compared with each other.
    """
    held = stored(texts.join(parts, "id", "left_semi").select("id", "text").mapInArrow(_shingles(k), "id long, shingles array<long>"), "sets")
    each = held.select("id", F.explode("shingles").alias("s"))
    frequent = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one document alone come first; only their number matters.
    shared = each.join(frequent, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    ranked = shared.join(held.select("id", F.size("shingles").alias("n")), "id").join(parts, "id")
    need = F.ceil(F.col("n") * F.lit(percent) / 100)
    ranked = ranked.withColumn("alone", F.col("n") - F.size("shared")).withColumn("width", F.greatest(F.lit(0), (F.col("n") - need + 1 - F.col("alone")).cast("int")))
    prefix = stored(ranked.select("id", "component", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("width"))).alias("at", "e")).select("id", "component", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("e.s").alias("s")), "prefixes")
    sizes = prefix.groupBy("s", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("big"), F.count("*").alias("parts")).where("parts > 1").select("s", "big")
    mixed = prefix.join(largest, "s")
    left = mixed.where("component <> big").select("s", F.col("id").alias("pid"), F.col("n").alias("m"), F.col("left").alias("pleft"), F.col("component").alias("pc"))
    # At most the smaller rest is shared, from the first shared shingle on.
    enough = (100 + percent) * F.least("left", "pleft") >= percent * (F.col("n") + F.col("m"))
    once = (F.col("pid") < F.col("id")) | (F.col("component") == F.col("big"))
    pairs = mixed.join(left, "s").where((F.col("component") != F.col("pc")) & once).where(_fits(percent)).where(enough)
    return pairs.select(F.least("pid", "id").alias("a"), F.greatest("pid", "id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, slot: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both.
    component_id is the smallest id that links reach; kept marks the row that has it.
    A pair of the least similarity that links is missed with probability
    (1 - (percent/100)**rows)**bands, 5e-8 by default.

    Null or blank texts have no shingles and link with nothing. Rows that share an id
    belong together: each of its texts is compared, and what any of them is linked with
    is of one component with all. A row with a null id links with nothing, has
    a null component_id and is kept. Only id and text are read, so other columns can't
    clash. An empty table gives an empty result.
    """
    read = pick(docs, [id_col, text_col]).toDF("id", "text").select("id", F.xxhash64("text").alias("version"), "text")
    signed = stored(read.mapInArrow(_sign(shingle_words, bands, rows), "id long, version long, n long, digest binary, bands array<long>"), "signed")
    usable = signed.where("id is not null and digest is not null")

    # Exact copies: one vertex v for each set, with the smallest id that has it and a text of that id.
    one = usable.groupBy("digest").agg(F.min(F.struct("id", "version")).alias("at"))
    alike = stored(one.select("digest", F.monotonically_increasing_id().alias("v"), F.col("at.id").alias("rep"), F.col("at.version").alias("version")), "alike")
    reps = usable.join(alike.withColumnRenamed("rep", "id"), ["digest", "id", "version"]).dropDuplicates(["v"])
    placed = reps.select(F.col("v").alias("id"), "n", F.explode("bands").alias("key"))
    crowded = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "c")
    members = stored(placed.join(crowded, "key").select("key", "id", "n", "c"), "members")

    wanted = alike.join(members.select(F.col("id").alias("v")).distinct(), "v").select(F.col("rep").alias("id"), "version", "v")
    texts = stored(read.join(wanted, ["id", "version"]).groupBy(F.col("v").alias("id")).agg(F.max("text").alias("text")), "texts")
    # An id with several sets ties them together.
    many = usable.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("id")
    several = stored(usable.join(many, "id", "left_semi").select("id", "digest").distinct().join(alike.select("digest", "v"), "digest").select("id", "v"), "several")
    tied = several.join(several.groupBy("id").agg(F.min("v").alias("a")), "id").where("a <> v").select("a", F.col("v").alias("b"))

    # Slots of a few members each, however large the bucket: the first meets the others.
    dealt = members.withColumn("slot", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("c") / slot)))
    first = dealt.groupBy("key", "slot").agg(F.min("id").alias("pid"), F.min_by("n", "id").alias("m"))
    pairs = dealt.join(first, ["key", "slot"]).where((F.col("id") != F.col("pid")) & _fits(percent)).select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct()
    met = _measured(pairs, texts, shingle_words, percent)
    links = stored(met.where("similar").select("a", "b").union(tied), "links")
    label = stored(connected_components(links), "labels")

    # Buckets that are of several components still, but for those whose only pair has been compared.
    named = members.where("c > 2").join(label.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    parts = stored(named.join(split, "key", "left_semi").select("id", "component").distinct(), "parts")
    used = [members, texts, met, links, parts, several]
    if not parts.isEmpty():
        late = _measured(_rare_pairs(texts, parts, shingle_words, percent).join(met.select("a", "b"), ["a", "b"], "left_anti"), texts, shingle_words, percent)
        # Components of the first links, joined by the late ones.
        to_component = label.select(F.col("node").alias("b"), F.col("component").alias("to"))
        moved = late.where("similar").select("a", "b").join(to_component, "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        moved = moved.join(to_component.select(F.col("b").alias("a"), "to"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        over = stored(connected_components(moved.distinct()), "labels")
        every = label.select("node", "component").union(over.select("node", "node"))
        after = every.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").groupBy("node").agg(F.min(F.coalesce("to", "component")).alias("component"))
        used += [late, over, label]
        label = stored(after, "labels")

    # The smallest id of each component.
    own = alike.select(F.col("v").alias("node"), "rep").join(label.select("node", "component"), "node")
    named = own.select("node", "component").join(own.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("v"), "least")
    out = signed.select("id", "n", "digest").join(alike.select("digest", "v", "rep").join(named, "v", "left").select("digest", F.coalesce("least", "rep").alias("least")), "digest", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    discard(*used)
    return out.withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
