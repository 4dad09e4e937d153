"""Vector search for many vectors: cells of like vectors, in blocks that tell how near their rows can be to a query.

Cells are fitted on a bounded sample and hold every vector. A search scores the nearest cells of each
query; the exact one then goes on with the blocks that may still hold something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .search import in_scope, top

#: What bounds allow for rounding: of an angle, and of a score that is rounded to six digits.
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-6


@dataclass
class CellIndex:
    """centers: one unit vector a cell; blocks: block, cell, near, far, chunk_ids, repo_ids, embeddings (end to end); ranges: near and far of each cell.

    near and far are the least and greatest angle between a block's vectors and its center. The last
    cell, with a center of zeros, is for vectors of zeros.
    """

    centers: np.ndarray
    blocks: DataFrame
    ranges: np.ndarray


def _units(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-12)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    if any(len(x) != dims for x in column):
        raise ValueError(f"a vector has not {dims} numbers")
    return np.array(column.tolist(), np.float32).reshape(len(column), dims)


def _angles(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centers.T, -1.0, 1.0))


def fit_centers(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centers of at most `cells` cells by spherical k-means on `sample` vectors of vectors (chunk_id, embedding), those of the least key hashes.

    Only the sample comes to the driver. Without vectors there are no centers.
    """
    drawn = vectors.where("size(embedding) > 0").select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h", "embedding").limit(sample).toPandas()
    if drawn.empty:
        return np.zeros((0, 0))
    rows = _units(_matrix(drawn["embedding"], len(drawn["embedding"].iloc[0])))
    rows = rows[np.linalg.norm(rows, axis=1) > 0.5]
    _, first = np.unique(np.round(rows, 6), axis=0, return_index=True)
    centers = rows[np.sort(first)[:cells]].copy()
    for _ in range(rounds if len(centers) else 0):
        mine = np.argmax(rows @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, mine, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return np.vstack([centers, np.zeros((1, rows.shape[1]))])


def build_cells(vectors: DataFrame, centers: np.ndarray, block: int = 1024) -> CellIndex:
    """The index of vectors (chunk_id, repo_id, embedding), chunk_id unique; rows without a vector are left out, a vector of other length is an error.

    Vectors are sorted by cell and angle over all tasks, so that a cell of any size is dealt out by
    ranges, and cut into blocks of at most `block` rows: shells around the center.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("chunk_id", "repo_id")}
    dims, last = centers.shape[1] if centers.size else 0, len(centers) - 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            units = _units(_matrix(rows["embedding"], dims))
            angles = _angles(units, centers[:-1]) if last else np.zeros((len(rows), 0))
            empty = np.linalg.norm(units, axis=1) < 0.5
            cell = np.where(empty, last, angles.argmin(axis=1) if last else last)
            yield rows.assign(cell=cell.astype(np.int32), angle=np.where(empty, 0.0, angles.min(axis=1) if last else 0.0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one cell, at most block rows each; what is held is one block and one batch."""
        held = pd.DataFrame()
        for rows in batches:
            held = pd.concat([held, rows]) if len(held) else rows
            while len(held):
                run = int((held["cell"].to_numpy() == held["cell"].iloc[0]).sum())
                if run < block and run == len(held):
                    break
                yield made(held.iloc[: min(run, block)])
                held = held.iloc[min(run, block) :]
        if len(held):
            yield made(held)

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        zeros = rows["cell"].iloc[0] == last
        return pd.DataFrame({
            "block": [rows["chunk_id"].iloc[0]], "cell": [rows["cell"].iloc[0]], "near": [0.0 if zeros else rows["angle"].iloc[0]], "far": [np.pi if zeros else rows["angle"].iloc[-1]],
            "chunk_ids": [rows["chunk_id"].tolist()], "repo_ids": [rows["repo_id"].tolist()], "embeddings": [np.concatenate(rows["embedding"].to_list()).astype(np.float32)],
        })

    held = vectors.where("size(embedding) > 0").select("chunk_id", "repo_id", "embedding")
    placed = stored(held.mapInPandas(place, f"chunk_id {kinds['chunk_id']}, repo_id {kinds['repo_id']}, embedding array<float>, cell int, angle double"), "placed")
    order = ["cell", "angle", "chunk_id"]
    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, f"block {kinds['chunk_id']}, cell int, near double, far double, chunk_ids array<{kinds['chunk_id']}>, repo_ids array<{kinds['repo_id']}>, embeddings array<float>")
    blocks = stored(packed, "blocks")
    ranges = np.full((len(centers), 2), np.nan)
    for r in blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():  # one row a cell
        ranges[r["cell"]] = r["near"], r["far"]
    return CellIndex(centers, blocks, ranges)


def _bound(angle, near, far):
    """The greatest cosine that a vector between near and far of a center can have with a query at angle from it."""
    return np.cos(np.maximum(np.maximum(angle - far, near - angle) - ANGLE_SLACK, 0.0))


def _bound_column(angle: Column, near: Column, far: Column) -> Column:
    return F.cos(F.greatest(angle - far - ANGLE_SLACK, near - angle - ANGLE_SLACK, F.lit(0.0)))


def _scored(index: CellIndex, asked: DataFrame, k: int, group: int) -> DataFrame:
    """Of each row (query_id, block, embedding, least) the block's best k of at least `least`.

    Queries of a block are put together, up to `group` at a time, and meet it there: one product of two matrices a row.
    """
    dims = index.centers.shape[1]
    kinds = {"query": asked.schema["query_id"].dataType.simpleString(), **{c: index.blocks.schema[c].dataType.simpleString() for c in ("block", "chunk_ids", "repo_ids")}}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for rows in batches:
            held = pd.concat([held, rows]) if len(held) else rows
            # Each block's run of queries in pieces; the last run may go on in the next batch.
            names = held["block"].to_numpy()
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(held) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(held)].astype(int)
            pieces = [(a, min(a + group, e)) for s, e in zip(starts, ends, strict=True) for a in range(s, e, group)]
            for a, e in pieces[:-1]:
                yield made(held.iloc[a:e])
            held = held.iloc[pieces[-1][0] :] if pieces else held
        if len(held):
            yield made(held)

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "query_ids": [rows["query_id"].tolist()], "asked": [np.concatenate(rows["embedding"].to_list()).astype(np.float32)], "least": [rows["least"].tolist()]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                q, v = _units(np.asarray(r.asked).reshape(-1, dims)), _units(np.asarray(r.embeddings).reshape(-1, dims))
                sims = np.round(q @ v.T, 6)
                least = np.asarray(r.least, float)
                if len(v) > k:
                    least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                qi, vi = np.nonzero(sims >= least[:, None])
                best = pd.DataFrame({"q": qi, "score": sims[qi, vi], "chunk_id": np.asarray(r.chunk_ids)[vi], "repo_id": np.asarray(r.repo_ids)[vi]})
                best = best.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q").head(k)
                yield pd.DataFrame({"query_id": np.asarray(r.query_ids)[best["q"]], "chunk_id": best["chunk_id"], "repo_id": best["repo_id"], "score": best["score"]})

    one = lambda kind: kind.removeprefix("array<").removesuffix(">")
    queries = asked.select("block", "query_id", "embedding", "least").repartitionByRange("block", "query_id").sortWithinPartitions("block", "query_id")
    queries = queries.mapInPandas(pack, f"block {kinds['block']}, query_ids array<{kinds['query']}>, asked array<float>, least array<double>")
    met = queries.join(index.blocks.select("block", "chunk_ids", "repo_ids", "embeddings"), "block")
    return met.mapInPandas(score, f"query_id {kinds['query']}, chunk_id {one(kinds['chunk_ids'])}, repo_id {one(kinds['repo_ids'])}, score double")


def cell_search(queries: DataFrame, index: CellIndex, scopes: DataFrame | None = None, k: int = 30, probes: int | None = None, exact: bool = True, group: int = 256) -> DataFrame:
    """Cosine top k of each query (query_id, embedding), query_id unique, as vector_search gives it; any number of queries.

    First the `probes` nearest cells of a query are scored. With exact, the k-th score so far then
    rules out every block whose shell can't reach it, and what is left is scored too: the result is
    the exact one, ties included. Without, a hit may be missing. probes are 8 with exact, five eighths of
    the cells without, as vectors that don't cluster need that many for a recall of 0.9. The scope filter comes after the top k.
    Queries without a vector have no hits; to a vector of zeros all are equal.
    """
    probes = probes or (8 if exact else -(-5 * len(index.centers) // 8))
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    vectors = {c: index.blocks.schema[c].dataType.elementType.simpleString() for c in ("chunk_ids", "repo_ids")}
    if not index.centers.size:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id {vectors['chunk_ids']}, repo_id {vectors['repo_ids']}, score double, ord int, source string")
    # Sent to all tasks: cells times dimensions, whatever the number of vectors.
    shared = spark.sparkContext.broadcast((index.centers, index.ranges))

    def nearest(further: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centers, ranges = shared.value
            for rows in batches:
                if rows.empty:
                    continue
                units = _units(_matrix(rows["embedding"], centers.shape[1]))
                angles = _angles(units, centers)
                held = ~np.isnan(ranges[:, 0])
                rank = np.argsort(np.argsort(np.where(held, angles, 9.0), axis=1, kind="stable"), axis=1, kind="stable")
                if further:
                    reach = np.where(np.linalg.norm(units, axis=1, keepdims=True) < 0.5, 1.0, _bound(angles, ranges[:, 0], ranges[:, 1]))
                    qi, ci = np.nonzero(held & (rank >= probes) & (reach >= rows["least"].to_numpy()[:, None] - SCORE_SLACK))
                else:
                    qi, ci = np.nonzero(held & (rank < probes))
                yield pd.DataFrame({"query_id": rows["query_id"].to_numpy()[qi], "embedding": rows["embedding"].to_numpy()[qi], "cell": ci.astype(np.int32), "angle": angles[qi, ci], "least": rows["least"].to_numpy()[qi]})

        return run

    schema = f"query_id {kind}, embedding array<float>, cell int, angle double, least double"
    shells = index.blocks.select("cell", "block", "near", "far")
    asked = queries.where("size(embedding) > 0").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    first = asked.withColumn("least", F.lit(-2.0)).mapInPandas(nearest(False), schema).join(shells, "cell")
    order = [F.desc("score"), "chunk_id"]
    best = top(_scored(index, first, k, group), k, order)
    if exact:
        best = stored(best, "near")
        reached = best.where(F.col("ord") == k).select("query_id", F.col("score").alias("least"))
        going_on = asked.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        zeros = ~F.exists("embedding", lambda x: x != 0)
        further = going_on.mapInPandas(nearest(True), schema).join(shells, "cell").where(zeros | (_bound_column(F.col("angle"), F.col("near"), F.col("far")) >= F.col("least") - SCORE_SLACK))
        best = top(best.drop("ord").unionByName(_scored(index, further, k, group)), k, order)
    return in_scope(best, scopes).withColumn("source", F.lit("vector"))
