"""Changes to tables as new versions of them, snapshot differences and index maintenance.

Parquet has no MERGE, so each function gives the next version of its target. maintain.py
writes all of an index's tables beside the old ones and switches them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by order, of equals or without order the greatest of all columns, so that reruns agree."""
    others = [c for c in rows.columns if c not in keys and c != order]
    best = F.struct(*[F.col(c) for c in ([order] if order and order not in keys else []) + others] or [F.lit(0).alias("none_")])
    picked = rows.groupBy(*keys).agg(F.max(best).alias("last_"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"last_.{c}").alias(c) for c in rows.columns])


def _last_values(rows: DataFrame, keys: list[str], order: str | None, always: tuple[str, ...]) -> DataFrame:
    """One row a key: of each column the last value by order that isn't null, of the always columns the last row's."""
    others = [c for c in rows.columns if c not in keys and c != order]
    # Equal places in the order go by all columns, so that reruns agree.
    at = F.struct(*[F.col(c) for c in ([order] if order else []) + others] or [F.lit(0).alias("none_")])
    seen = lambda c: F.max_by(F.col(c), at) if c in always else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    picked = [seen(c).alias(c) for c in others] + ([F.max(order).alias(order)] if order and order not in keys else [])
    return rows.groupBy(*keys).agg(*picked or [F.count("*").alias("n_")]).select(*rows.columns)


def _merged(target: DataFrame, one: DataFrame, keys: list[str], value) -> DataFrame:
    """Full outer merge with rows of which each key has one; value(column, old, new) gives the columns that aren't keys."""
    t, r = target.withColumn("in_t", F.lit(True)).alias("t"), one.withColumn("in_r", F.lit(True)).alias("r")
    both = t.join(r, [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"r.{c}") if c in one.columns else F.lit(None)
        out.append(F.coalesce(old, new).alias(c) if c in keys else value(c, old, new).alias(c))
    return both.select(*out)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows replace columns (all by default) where their key is there, else come in; of several for a key the last by order."""
    columns = columns or [c for c in target.columns if c not in keys]
    has_new, has_old = F.coalesce(F.col("in_r"), F.lit(False)), F.coalesce(F.col("in_t"), F.lit(False))
    return _merged(target, _last(rows, keys, order), keys, lambda c, old, new: F.when(has_new & (~has_old | F.lit(c in columns)), new).otherwise(old))


def upsert_coalesce(target: DataFrame, rows: DataFrame, keys: list[str], always: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """An upsert in which nulls don't overwrite, but in the always columns.

    Several rows for a key act as one after the other, by order: each column gets its last value
    that isn't null, an always column the last row's.
    """
    has_new = F.coalesce(F.col("in_r"), F.lit(False))
    return _merged(target, _last_values(rows, keys, order, always), keys, lambda c, old, new: F.when(has_new, new).otherwise(old) if c in always else F.coalesce(new, old))


def _first(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the first by order, of equals or without order the least of all columns."""
    others = [c for c in rows.columns if c not in keys and c != order]
    best = F.struct(*[F.col(c) for c in ([order] if order and order not in keys else []) + others] or [F.lit(0).alias("none_")])
    picked = rows.groupBy(*keys).agg(F.min(best).alias("first_"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"first_.{c}").alias(c) for c in rows.columns])


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target with the first row by order of each key that it hasn't."""
    return target.unionByName(claim(target, rows, keys, order).select(*target.columns))


def claim(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows that would be inserted: the first by order for each key that isn't there yet."""
    return _first(rows, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert_no_downgrade(target: DataFrame, rows: DataFrame, keys: list[str], status: str = "status", final: str = "READY", order: str | None = None) -> DataFrame:
    """An upsert that leaves rows of the final status as they are.

    Several rows for a key act as one after the other, by order: the first of them that has the
    final status is the last that counts.
    """
    done = rows.where(F.col(status) == final)
    # A row with the final status wins over all others of its key; of several the first.
    ended = _first(done, keys, order)
    going = _last(rows, keys, order).join(ended.select(*keys), keys, "left_anti")
    stays, has_new = F.coalesce(F.col(f"t.{status}") == final, F.lit(False)), F.coalesce(F.col("in_r"), F.lit(False))
    return _merged(target, ended.unionByName(going), keys, lambda c, old, new: F.when(has_new & ~stays, new).otherwise(old))


def delete_by(target: DataFrame, keys_df: DataFrame) -> DataFrame:
    return target.join(keys_df.distinct(), keys_df.columns, "left_anti")


def replace_partition(target: DataFrame, rows: DataFrame, part: str) -> DataFrame:
    """All rows of the parts that rows has are replaced by rows."""
    return target.join(rows.select(part).distinct(), part, "left_anti").unionByName(rows)


def disable_where(target: DataFrame, keys_df: DataFrame, flag: str = "enabled") -> DataFrame:
    k = keys_df.distinct().withColumn("hit_", F.lit(True))
    return target.join(k, keys_df.columns, "left").withColumn(flag, F.col(flag) & F.col("hit_").isNull()).drop("hit_").select(*target.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_id", "path"), hash_col: str = "blob_sha") -> DataFrame:
    """keys, status: added, removed, modified or unchanged between two manifests."""
    o, n = old.select(*keys, F.col(hash_col).alias("old_")), new.select(*keys, F.col(hash_col).alias("new_"))
    both = o.withColumn("o_", F.lit(True)).join(n.withColumn("n_", F.lit(True)), list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "removed").when(F.col("old_").eqNullSafe(F.col("new_")), "unchanged").otherwise("modified").alias("status"))


def split_by_hash(targets: DataFrame, stored_files: DataFrame, force: bool = False) -> DataFrame:
    """targets with work: whether the file has to be read, as its hash isn't the stored one."""
    s = stored_files.select("file_id", F.col("blob_sha").alias("stored_"))
    return targets.join(s, "file_id", "left").withColumn("work", F.lit(force) | ~F.coalesce(F.col("stored_") == F.col("blob_sha"), F.lit(False))).drop("stored_")


def chunk_diff(new: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """chunk_id, status: dirty (new or changed), clean or stale, over the files at hand."""
    both = new.select("chunk_id", F.col("content_hash").alias("new_")).join(stored_chunks.select("chunk_id", F.col("content_hash").alias("old_")), "chunk_id", "full_outer")
    return both.select("chunk_id", F.when(F.col("new_").isNull(), "stale").when(F.col("old_").eqNullSafe(F.col("new_")), "clean").otherwise("dirty").alias("status"))


def select_targets(tree: DataFrame, jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of tree (repo_id, path, size, ...) that an index job is to read, with those left out by the path rules gone.

    jobs: repo_id, job_type. An INCREMENTAL_INDEX reads the changed (repo_id, path) ones that
    are still there, any other job all of its repo.
    """
    from ..functions.paths import skip_reason

    fit = tree.where(skip_reason(F.col("path"), F.col("size")).isNull()).join(jobs.select("repo_id", "job_type"), "repo_id")
    part = fit.where("job_type = 'INCREMENTAL_INDEX'").join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return fit.where("job_type <> 'INCREMENTAL_INDEX'").unionByName(part).drop("job_type")


def index_counters(update: dict[str, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """By repo what update_index did: files_indexed, files_removed, chunks_written, chunks_removed, edges_written."""
    diff = update["diff"].groupBy("repo_id").agg(F.count_if(F.col("status").isin("added", "modified")).alias("files_indexed"), F.count_if(F.col("status") == "removed").alias("files_removed"))
    dirty = update["dirty"].groupBy("repo_id").agg(F.count("*").alias("chunks_written"))
    stale = update["stale_chunks"].groupBy("repo_id").agg(F.count("*").alias("chunks_removed"))
    out = diff.join(dirty, "repo_id", "left").join(stale, "repo_id", "left")
    if edges is not None:
        own = edges.join(update["dirty"].select(F.col("chunk_id").alias("from_node")), "from_node", "left_semi")
        out = out.join(own.groupBy("repo_id").agg(F.count("*").alias("edges_written")), "repo_id", "left")
    return out.na.fill(0)


def update_index(files: DataFrame, chunks: DataFrame, snapshot: DataFrame, chunker, force: bool = False) -> dict[str, DataFrame]:
    """The next versions of files and chunks for all repos at once, with what changed.

    Only files whose hash differs are chunked; chunks of equal hash keep their row, and
    with it their commit; files that are gone lose their chunks.
    """
    diff = snapshot_diff(files, snapshot)
    touched = diff.where(F.col("status").isin("added", "modified") | (F.lit(force) & (F.col("status") == "unchanged"))).select("repo_id", "path")
    gone = diff.where("status = 'removed'").select("repo_id", "path")
    made = chunker(snapshot.join(touched, ["repo_id", "path"], "left_semi"))
    of_touched = chunks.join(touched, ["repo_id", "path"], "left_semi")
    status = chunk_diff(made, of_touched)
    dirty = made.join(status.where("status = 'dirty'"), "chunk_id", "left_semi")
    stale = status.where("status = 'stale'").select("chunk_id")
    stale_chunks = of_touched.join(stale, "chunk_id", "left_semi").unionByName(chunks.join(gone, ["repo_id", "path"], "left_semi"))
    kept = chunks.join(gone, ["repo_id", "path"], "left_anti").join(stale.union(dirty.select("chunk_id")), "chunk_id", "left_anti")
    columns = [c for c in chunks.columns if c in made.columns]
    return {"chunks": kept.select(*columns).unionByName(dirty.select(*columns)), "files": snapshot.select(*[c for c in files.columns if c in snapshot.columns]), "made": made, "dirty": dirty, "stale": stale, "stale_chunks": stale_chunks, "diff": diff}


def in_use(selections: DataFrame, allowed: DataFrame) -> DataFrame:
    return selections.where("enabled").select("repo_id").union(allowed.where("enabled").select("repo_id")).distinct()


def purge_orphans(index: dict[str, DataFrame], used: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of repos that nobody uses."""
    return {name: df.join(used.select("repo_id"), "repo_id", "left_semi") for name, df in index.items()}


def sync_artifacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, action (write, keep, delete), shard: what makes the stored set the new one."""
    both = old.select("key", F.col("hash").alias("old_")).join(new.select("key", F.col("hash").alias("new_")), "key", "full_outer")
    return both.select("key", F.when(F.col("new_").isNull(), "delete").when(F.col("old_").eqNullSafe(F.col("new_")), "keep").otherwise("write").alias("action"), F.regexp_extract("key", r"^(.*?)(?:_v\d+)?(?:\.\d+)?\.[^.]*$", 1).alias("shard"))


#: Columns of an artifact's row that a later report replaces; the others stay as the first one gave them.
ARTIFACT_STATE = ["status", "artifact_uri", "content_hash", "metadata_json", "error"]


def merge_artifacts(manifest: DataFrame, reports: DataFrame, order: str) -> DataFrame:
    """The next version of an artifact manifest after reports, which act one after the other by order.

    Both have id, repo_id, artifact_type, commit_sha, language, producer and the state: status,
    artifact_uri, content_hash, metadata_json, error. An id's first report gives all columns; each
    later one replaces the state, nulls too, so that a success clears the error of a failure and a
    failure the uri and hash of a success. A null language is empty.
    """
    rows = reports.withColumn("language", F.coalesce("language", F.lit("")))
    first, last = _first(rows, ["id"], order), _last(rows, ["id"], order)
    fixed = [c for c in manifest.columns if c not in ("id", *ARTIFACT_STATE)]
    one = first.select("id", *fixed).join(last.select("id", *ARTIFACT_STATE), "id")
    has_new, has_old = F.coalesce(F.col("in_r"), F.lit(False)), F.coalesce(F.col("in_t"), F.lit(False))
    return _merged(manifest, one, ["id"], lambda c, old, new: F.when(has_new & (~has_old | F.lit(c in ARTIFACT_STATE)), new).otherwise(old))
