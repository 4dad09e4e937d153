"""A Merkle tree over a dataset: one tree for each source, and one over the sources' roots.

Time-forward processing. Nodes are labelled so that a parent comes right after its last
child. A sweep in label order takes a node's messages, its children's digests, from a
priority queue and puts its own digest there for its parent. The reversed sweep goes from
the root down: a node hands each child the digests of the child's siblings and its own
proof. Messages between tasks are rows, dealt by label and sorted by Spark, which spills
them; within a task the queue holds one path's worth of messages on the way up and one
subtree's on the way down.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, sized, stored


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def row_digest(columns: Sequence[Column]) -> Column:
    """sha256 in hex of the columns' values: each its UTF-8 bytes' number, a colon and the value, or - for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_height(n: int, fan: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // fan), height + 1
    return height


def folded(leaf: bytes, proof: Sequence[bytes]) -> bytes:
    """The root that follows from a leaf and its siblings: before and after it, level by level."""
    for before, after in zip(proof[::2], proof[1::2], strict=True):
        leaf = digest(before + leaf + after)
    return leaf


def _label(level: int, i: int, fan: int) -> tuple[int, int]:
    """Place in the sweep of node i of a level: after all leaves below it and its children."""
    return (i + 1) * fan**level - 1, level


def swept(leaves: Iterator[tuple[int, bytes]], levels: int, fan: int, log: dict | None = None) -> bytes:
    """The digest so many levels above leaves (place, digest), which ascend; log gets every inner node's children by label."""
    queue: list[tuple[tuple[int, int], int, bytes]] = []
    top = b""

    def forward(i: int, level: int, own: bytes) -> None:
        nonlocal top
        if level == levels:
            top = own
        else:
            heapq.heappush(queue, (_label(level + 1, i // fan, fan), i, own))

    def settle(before: tuple[int, int] | None) -> None:
        while queue and (before is None or queue[0][0] < before):
            label, messages = queue[0][0], []
            while queue and queue[0][0] == label:
                messages.append(heapq.heappop(queue)[1:])
            if log is not None:
                log[label] = messages
            forward(messages[0][0] // fan, label[1], digest(b"".join(m[1] for m in messages)))

    for place, own in leaves:
        settle(_label(0, place, fan))
        forward(place, 0, own)
    settle(None)
    return top


def proofs(leaves: list[tuple[int, bytes]], levels: int, fan: int, above: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place, proof) of every leaf below a node whose own proof is above, from the last leaf to the first."""
    log: dict = {}
    swept(iter(leaves), levels, fan, log)
    first = leaves[0][0]
    queue = [(tuple(-x for x in _label(levels, first // fan**levels, fan)), first // fan**levels, above)]
    while queue:
        label, i, proof = heapq.heappop(queue)
        level = -label[1]
        if level == 0:
            yield i, proof
            continue
        children = [c for _, c in log[tuple(-x for x in label)]]
        for j in range(len(children)):
            child = i * fan + j
            siblings = [b"".join(children[:j]), b"".join(children[j + 1 :])]
            heapq.heappush(queue, (tuple(-x for x in _label(level - 1, child, fan)), child, siblings + proof))


def _rows(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _upward(fan: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in groupby(_rows(batches, ["tree", "block", "pos", "n", "digest"]), key=lambda r: r[:2]):
            head = next(rows)
            n, climb = head[3], min(levels, tree_height(head[3], fan))
            leaves = ((r[2], r[4]) for one in ([head], rows) for r in one)
            out.append((tree, block, -(-n // fan**levels), swept(leaves, climb, fan)))
            if len(out) == 1000:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["tree", "pos", "n", "digest"])


#: What the sweep down gives: messages for the next nodes, or for the leaves what follows from their proofs.
_MESSAGE = {"tree": pa.string(), "pos": pa.int64(), "above": pa.list_(pa.binary()), "subroot": pa.binary()}
_PROVED = {"id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "proof": pa.list_(pa.string())}


def _downward(fan: int, levels: int, last: bool, whole: bool):
    """Rows of a block: its message first, then its nodes."""
    schema = pa.schema(_PROVED if last else _MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in groupby(_rows(batches, ["tree", "block", "pos", "n", "digest", "above", "subroot", "id", "claim"]), key=lambda r: r[:2]):
            head, *nodes = rows
            above, subroot = head[5], head[6]
            own = {r[2]: r for r in nodes}
            climb, out = min(levels, tree_height(nodes[0][3], fan)), []
            for place, proof in proofs([(r[2], r[4]) for r in nodes], climb, fan, above):
                if last:
                    leaf, i, claim = own[place][4], own[place][7], own[place][8]
                    steps = [p.decode() for p in proof] if whole else None
                    out.append((i, leaf.decode(), subroot.decode(), hashlib.sha256(b"".join(proof)).hexdigest(), folded(claim or leaf, proof).decode(), steps))
                else:
                    out.append((tree, place, proof, subroot))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)

    return run


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place within their tree by order, and n, the tree's rows: a table.

    Rows are dealt by ranges and sorted within, so that no tree meets in one task; places follow
    from the rows that each part has of each tree. order ends with a column without ties.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted")
    # A row for each part and tree in it: as many as parts and trees together.
    parts = at.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    by_tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(by_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = stored(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(by_tree).alias("n")), "parts")
    placed = at.withColumn("part", F.shiftright("at", 33)).join(sized(begins), ["tree", "part"])
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _levels(leaves: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Tables of nodes (tree, pos, n, digest), each so many levels above the one before; the last has each tree's root."""
    most, out = leaves.agg(F.max("n")).first()[0] or 0, [leaves]
    while len(out) == 1 or most > 1:
        nodes = out[-1].select("tree", F.floor(F.col("pos") / fan**levels).alias("block"), "pos", "n", "digest")
        made = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        out.append(stored(made.mapInArrow(_upward(fan, levels), "tree string, pos long, n long, digest binary"), "nodes"))
        most = -(-most // fan**levels)
    return out


def _delivered(tables: list[DataFrame], messages: DataFrame, fan: int, levels: int, last: bool, whole: bool = False) -> DataFrame:
    """What the first of tables gets when messages (tree, pos, above, subroot) go down from the last."""
    for k in range(len(tables) - 2, -1, -1):
        end, nodes = last and k == 0, tables[k]
        rows = nodes.select(
            "tree", F.floor(F.col("pos") / fan**levels).alias("block"), "pos", "n", "digest", F.lit(None).cast("array<binary>").alias("above"), F.lit(None).cast("binary").alias("subroot"),
            *([F.col("id"), F.col("claim")] if end else [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim")]),
        )
        heads = messages.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), "above", "subroot", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
        dealt = heads.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        given = "id long, leaf string, subroot string, proof_sha256 string, folded_root string, proof array<string>" if end else "tree string, pos long, above array<binary>, subroot binary"
        out = dealt.mapInArrow(_downward(fan, levels, end, whole), given)
        messages = out if end else stored(out, "messages")
    return messages


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), claims: Mapping[str, Column] | None = None, fan: int = 16, levels: int = 3,
    proofs: bool = False, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified (, proof).

    A leaf is row_digest() of columns. Leaves of a source ascend by id, null ids first, equal ids by
    digest; every fan nodes in a row become one, until one is left: the subroot. Subroots, by source,
    a null source first, others by their bytes, become the root likewise. proof, if asked for, has two
    entries a level, from the leaf to the root: all siblings before the node and all after, each joined;
    proof_sha256 is the digest of it all. claims: columns to put in place of those named, for the rows
    that someone hands in; folded_root is what follows from such a row and the proof, verified whether
    that is the root. A claim that is null for a row is a null value.

    Null and empty values have different digests. Repeated rows are leaves of their own, in places next
    to each other, whichever of them comes first. Only columns, id and source are read. An empty table
    gives an empty result. Work is two sorted shuffles of digests and one by ranges; a task holds one
    block of fan ** levels nodes, and no tree meets in one task. All rounds are tables in the shared folder.
    """
    plain = [F.col(f"`{c}`") for c in columns]
    claimed = row_digest([(claims or {}).get(c, p) for c, p in zip(columns, plain, strict=True)])
    # A null source sorts first; = keeps all others in their order.
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), tree.alias("tree"), row_digest(plain).cast("binary").alias("digest"), *([claimed.cast("binary").alias("claim")] if claims else []))
    read = read.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))) if claims else read.withColumn("claim", F.lit(None).cast("binary"))
    leaves = stored(read.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    ranked = stored(_ranked(leaves, ["id", "digest", "nth"]), "ranked")
    tables = _levels(ranked, fan, levels)

    sources = stored(_ranked(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]), "sources")
    above = _levels(sources, fan, levels)
    top = above[-1].first()
    root = top["digest"].decode() if top else ""
    start = above[-1].select("tree", "pos", F.array().cast("array<binary>").alias("above"), F.lit(None).cast("binary").alias("subroot"))
    of_sources = _delivered(above, start, fan, levels, False).select("pos", "above")
    heads = stored(sources.join(of_sources, "pos").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "above", F.col("digest").alias("subroot")), "messages")

    out = _delivered(tables, heads, fan, levels, True, proofs)
    discard(leaves, *above)
    found = [F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")]
    return out.select(*found, *(["proof"] if proofs else []))
