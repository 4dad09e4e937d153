"""Event streams over the batch operators: the same functions, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import skip_reason
from ..operators import tables


def _field(name: str):
    """A lambda that gives an array field, empty for null."""
    return lambda c: F.coalesce(c[name], F.array().cast("array<string>"))


def push_jobs(pushes: DataFrame, selections: DataFrame, allowed: DataFrame) -> DataFrame:
    """Index jobs of pushes to default branches: changed and removed indexable paths, one job a tenant, else one for an allowed repo.

    A path that is removed and added again counts as changed. No state: works on a stream and on a batch.
    """
    main = pushes.where(F.col("ref").isNull() | (F.col("ref") == F.concat(F.lit("refs/heads/"), "repository.default_branch")))

    def paths(*names: str):
        return F.array_distinct(F.flatten(F.concat(*[F.transform(F.col("commits"), _field(n)) for n in names])))

    good = lambda a: F.filter(a, lambda p: skip_reason(p, F.lit(None).cast("long")).isNull())
    sets = main.withColumn("changed", paths("added", "modified")).withColumn("removed", F.array_except(paths("removed"), F.col("changed")))
    sets = sets.select(F.lower("repository.full_name").alias("repo_id"), "after", good("changed").alias("changed"), good("removed").alias("removed")).where((F.size("changed") > 0) | (F.size("removed") > 0))
    tenants = selections.where("enabled").select("repo_id", "tenant_id").distinct()
    open_ = allowed.where("enabled").select("repo_id").join(tenants.select("repo_id"), "repo_id", "left_anti").distinct().withColumn("tenant_id", F.lit(None).cast(tenants.schema["tenant_id"].dataType))
    return sets.join(tenants.unionByName(open_), "repo_id")


def grant_events(installations: DataFrame) -> DataFrame:
    """One row for each repo that an installation event adds or removes, removals first; a deleted installation loses all it lists.

    n is the place within the event; a column ts is kept. Without the columns action and
    repositories only the added and removed lists count.
    """
    has = lambda c: c in installations.columns
    none = F.array().cast("array<struct<repo_id:string,change:string>>")
    each = lambda c, change: F.transform(c, lambda r: F.struct(F.lower(r["full_name"]).alias("repo_id"), F.lit(change).alias("change")))
    of = lambda c, change: F.coalesce(each(F.col(c), change), none) if has(c) else none
    deleted = F.coalesce(F.col("action") == "deleted", F.lit(False)) if has("action") else F.lit(False)
    removed = F.when(deleted, of("repositories", "revoke")).otherwise(of("repositories_removed", "revoke"))
    added = F.concat(F.when(deleted, none).otherwise(of("repositories", "grant")), of("repositories_added", "grant"))
    keys = [F.col("installation.id").alias("installation_id"), *[F.col(c) for c in ("ts",) if has(c)]]
    each_row = installations.select(*keys, F.posexplode(F.concat(removed, added)).alias("n", "r"))
    return each_row.select("installation_id", "r.*", *[c for c in ("ts",) if has(c)], "n")


def grant_changes(changes: DataFrame, grants: DataFrame, selections: DataFrame, allowed: DataFrame, installations: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """What grants and revocations (installation_id, repo_id, change and the order columns) make of the tables.

    grants: the next version, where a pair's last change decides. selections (tenant_id,
    repo_id, enabled) and allowed (repo_id, enabled): a revocation switches off the repo
    for the installation's tenants and in the allow list, and a later grant doesn't switch
    it on again. jobs (tenant_id, repo_id): full index runs, one for each granted repo and
    tenant that had it on when it was granted. unused: revoked repos that are on nowhere.
    Repeated events change nothing more.
    """
    at = F.struct(*[F.col(c) for c in order])
    kind = lambda k, f: f(F.when(F.col("change") == k, at))
    by = changes.groupBy("installation_id", "repo_id").agg(kind("grant", F.max).alias("last_grant"), kind("grant", F.min).alias("first_grant"), kind("revoke", F.max).alias("last_revoke"), kind("revoke", F.min).alias("first_revoke"))
    stands = F.col("last_grant").isNotNull() & (F.col("last_revoke").isNull() | (F.col("last_grant") > F.col("last_revoke")))
    pair = ["installation_id", "repo_id"]
    next_grants = grants.join(by, pair, "left_anti").unionByName(by.where(stands).select(*pair), allowMissingColumns=True)
    tenants = installations.select("installation_id", "tenant_id").distinct()
    revoked = by.where("last_revoke is not null").join(tenants, "installation_id").select("tenant_id", "repo_id")
    gone = by.where("last_revoke is not null").select("repo_id").distinct()
    off, closed = tables.disable_where(selections, revoked), tables.disable_where(allowed, gone)
    granted = by.where(F.col("first_grant").isNotNull()).join(tenants, "installation_id")
    # A tenant may have the repo by several installations: what any of them revoked before is off.
    before = by.where("first_revoke is not null").join(tenants, "installation_id").groupBy("tenant_id", "repo_id").agg(F.min("first_revoke").alias("off_at"))
    jobs = granted.join(selections.where("enabled").select("tenant_id", "repo_id").distinct(), ["tenant_id", "repo_id"]).join(before, ["tenant_id", "repo_id"], "left")
    jobs = jobs.where(F.col("off_at").isNull() | (F.col("first_grant") < F.col("off_at"))).select("tenant_id", "repo_id").distinct()
    unused = gone.join(tables.in_use(off, closed), "repo_id", "left_anti")
    return {"grants": next_grants, "selections": off, "allowed": closed, "jobs": jobs, "unused": unused}


def with_grants(read: Callable[[], dict[str, DataFrame]], write: Callable[[dict[str, DataFrame], int], None], purge: Callable[[DataFrame, int], None], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over installation events.

    read gives grants, selections, allowed and installations as they stand; write stores
    grant_changes' tables and jobs by epoch; then purge gets the repos to drop, checked
    again against the tables as they stand by then, so that one that came back stays.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        out = grant_changes(grant_events(batch), order=order, **read())
        gone = out["unused"].persist()
        gone.count()  # as of these tables, before write gives the next ones
        write(out, epoch)
        now = read()
        purge(gone.join(tables.in_use(now["selections"], now["allowed"]), "repo_id", "left_anti"), epoch)
        gone.unpersist()

    return run


def run_skip_reason(own: list[str]):
    """Why a CI run isn't looked at: not completed, not failed, one of our own repos; null otherwise."""
    return F.when(F.col("action") != "completed", "not completed").when(~F.coalesce(F.col("workflow_run.conclusion") == "failure", F.lit(False)), "not a failure").when(F.lower("repository.full_name").isin([o.lower() for o in own]), "pipeline repo")


def dedupe_events(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay; the watermark bounds the state."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def claim_runs(batch: DataFrame, claims: DataFrame, keys: tuple[str, ...] = ("run_id", "attempt")) -> DataFrame:
    """The events of a micro-batch that nobody has claimed, one for each key; append their keys to the claims."""
    return tables.claim(claims, batch, list(keys))


def released(claims: DataFrame, failed: DataFrame, keys: tuple[str, ...] = ("run_id", "attempt")) -> DataFrame:
    """Claims without those of failed runs that haven't been posted."""
    return tables.delete_by(claims, failed.where("not posted").select(*keys))


def with_retry(handle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], max_retries: int, good: str, retry: str, dead: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: handle splits a batch in done and failed rows; failed ones go to the retry table, after max_retries to the dead ones.

    Each epoch has a folder of its own in every table and overwrites it, so that a replayed
    epoch writes nothing twice. retried() gives back what is to be tried again.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = batch if "attempt" in batch.columns else batch.withColumn("attempt", F.lit(0))
        done, failed = (df.persist() for df in handle(rows))  # a handler with effects runs once for each
        again = failed.withColumn("attempt", F.col("attempt") + 1)
        for df, path in ((done, good), (again.where(F.col("attempt") <= max_retries), retry), (again.where(F.col("attempt") > max_retries), dead)):
            df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        done.unpersist()
        failed.unpersist()

    return run


def retried(spark, retry: str, after: int = -1) -> DataFrame:
    """The rows that with_retry put back in epochs after the given one, with their attempt, for another batch."""
    return spark.read.parquet(retry).where(F.col("epoch") > after).drop("epoch")


_STATUS = "repo_id string, status string, files long, chunks long, error string, started timestamp, finished timestamp"


def _advance(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = list(state.get) if state.exists else ["PENDING", None, None, None, None, None]
    events = pd.concat(list(rows)).sort_values(["ts", "status"])
    for e in events.itertuples(index=False):
        now[0] = e.status
        now[1] = now[1] if pd.isna(e.files) else int(e.files)
        now[2] = now[2] if pd.isna(e.chunks) else int(e.chunks)
        now[3] = None if pd.isna(e.error) else e.error  # always overwritten
        if e.status == "INDEXING":
            now[4], now[5] = e.ts.to_pydatetime(), None
        elif e.status in ("READY", "FAILED"):
            now[5] = e.ts.to_pydatetime()
    state.update(tuple(now))
    yield pd.DataFrame([(key[0], *now)], columns=["repo_id", "status", "files", "chunks", "error", "started", "finished"]).astype({"files": "Int64", "chunks": "Int64"})


def status_lifecycle(stream: DataFrame) -> DataFrame:
    """The current status of each repo (repo_id, status, files, chunks, error, ts): nulls keep counters, errors are always replaced."""
    return stream.groupBy("repo_id").applyInPandasWithState(_advance, _STATUS, _STATUS.split(", ", 1)[1], "update", GroupStateTimeout.NoTimeout)


def status_feed(stream: DataFrame) -> DataFrame:
    """Repos by state and their chunks in all, as a running aggregate."""
    return stream.groupBy().agg(F.count_if(F.col("status") == "READY").alias("ready"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status").isin("PENDING", "INDEXING")).alias("active"), F.sum("chunks").alias("chunks"))


def _keep_until(state: GroupState, last: int, keep: int) -> None:
    """Let Spark drop the state once the watermark is past the last event by keep ms."""
    state.setTimeoutTimestamp(max(last + keep, state.getCurrentWatermarkMs() + 1))


def _with_expiry(stream: DataFrame, keep: timedelta | None, delay: str) -> tuple[DataFrame, str, int | None]:
    """The stream with event time in ms as at_ and, with keep, a watermark; the kind of timeout; keep in ms."""
    timed = stream.withColumn("at_", F.unix_millis("ts"))
    if keep is None:
        return timed, GroupStateTimeout.NoTimeout, None
    return timed.withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout, int(keep.total_seconds() * 1000)


def _forward(keep: int | None):
    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most, last = state.get if state.exists else (-1, None)
        kept = []
        for e in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            if keep is not None and last is not None and e.at_ > last + keep:
                most = -1
            last = max(int(e.at_), last if last is not None else int(e.at_))
            if e.rank > most:
                most = int(e.rank)
                kept.append((key[0], most, e.ts))
        state.update((most, last))
        if keep is not None:
            _keep_until(state, last, keep)
        yield pd.DataFrame(kept, columns=["key", "rank", "ts"])

    return run


def forward_only(stream: DataFrame, keep: timedelta | None = None, delay: str = "1 hour") -> DataFrame:
    """Events (key, rank, ts) whose rank is above all earlier ones of their key.

    With keep, a key that had no event for so long begins anew, wherever batches end, and its
    state is dropped when the watermark has passed that; without, it is kept for ever.
    """
    timed, timeout, ms = _with_expiry(stream, keep, delay)
    return timed.groupBy("key").applyInPandasWithState(_forward(ms), "key string, rank int, ts timestamp", "most int, last long", "append", timeout)


def _claim(keep: int | None):
    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        claimed, posted, last = state.get if state.exists else (False, False, None)
        out = []
        for e in pd.concat(list(rows)).sort_values(["at_", "kind"]).itertuples(index=False):
            if keep is not None and last is not None and e.at_ > last + keep:
                claimed = posted = False
            last = max(int(e.at_), last if last is not None else int(e.at_))
            if e.kind == "run" and not claimed:
                claimed = True
                out.append((*key, e.ts))
            elif e.kind == "posted":
                posted = True
            elif e.kind == "failed" and not posted:
                claimed = False
        state.update((claimed, posted, last))
        if keep is not None:
            _keep_until(state, last, keep)
        yield pd.DataFrame(out, columns=["run_id", "attempt", "ts"])

    return run


def claimed_runs(stream: DataFrame, keep: timedelta | None = None, delay: str = "1 hour") -> DataFrame:
    """Of events (run_id, attempt, kind, ts) the runs to work on: the first one of a run's attempt, and the first after each failure.

    kind: run asks for work, failed gives the claim back unless the attempt was posted before,
    posted makes it final. Equal times act in the order failed, posted, run. The claims are
    Spark's state, so that a replayed batch gives the same; keep as in forward_only().
    """
    timed, timeout, ms = _with_expiry(stream.select("run_id", "attempt", "kind", "ts"), keep, delay)
    return timed.groupBy("run_id", "attempt").applyInPandasWithState(_claim(ms), "run_id long, attempt int, ts timestamp", "claimed boolean, posted boolean, last long", "append", timeout)


def with_fresh_scopes(read: Callable[[], DataFrame], handle: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the slowly changing scope table anew for each batch."""
    return lambda batch, epoch: handle(batch, read(), epoch)
