"""Results of evaluation runs, kept by run: the last one, a pinned baseline, and all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Versions, bucket_of

#: One row a case and run; more columns are not kept.
RESULTS = "dataset string, run_id string, ran_at timestamp, id string, composite double, citation_f1 double, source_recall double, negative boolean, error string, total_ms long"


class Reports:
    """Runs in versioned buckets by run id. The names of the last and of the pinned run are facts of the manifest,
    so that readers see a run's rows and that it is the last one by the same switch."""

    def __init__(self, versions: Versions):
        self.versions = versions

    def add(self, results: DataFrame) -> int:
        """Store runs (RESULTS); a run that is stored already is replaced. Rows without a run are an error. The new version."""
        names = [f.split()[0] for f in RESULTS.split(", ")]
        rows, base, of = results.select(*names), self.versions.manifest(), bucket_of(F.col("run_id"), self.versions.buckets)
        state = rows.agg(F.count_if(F.col("run_id").isNull()).alias("none"), F.max_by("run_id", F.struct("ran_at", "run_id")).alias("last"), F.collect_set(of).alias("touched")).first()
        if state["none"]:
            raise ValueError(f"{state['none']} results without a run id")
        if state["last"] is None:
            return base["version"]
        held = self.versions.read("runs", RESULTS, state["touched"], base).join(rows.select("run_id").distinct(), "run_id", "left_anti").select(*names)
        staged = self.versions.stage("runs", held.unionByName(rows), of, spread=F.col("id"))
        return self.versions.commit(base, replaced={"runs": (state["touched"], staged)}, facts={"latest": state["last"]})

    def pin(self, run_id: str | None = None) -> int:
        """Make a stored run, the last one by default, the baseline from now on."""
        base = self.versions.manifest()
        run_id = run_id or base["facts"].get("latest")
        if run_id is None or self.run(run_id, base).isEmpty():
            raise ValueError(f"no run {run_id}")
        return self.versions.commit(base, facts={"baseline": run_id})

    def run(self, run_id: str | None, manifest: dict | None = None) -> DataFrame:
        """The results of a run, read from its bucket alone; none for null."""
        bucket = [] if run_id is None else [self.versions.spark.range(1).select(bucket_of(F.lit(run_id), self.versions.buckets)).first()[0]]
        return self.versions.read("runs", RESULTS, bucket, manifest).where(F.col("run_id") == run_id)

    def latest(self) -> DataFrame:
        """The results of the run that was stored last."""
        now = self.versions.manifest()
        return self.run(now["facts"].get("latest"), now)

    def baseline(self) -> DataFrame:
        """The results of the pinned run, as they stand; no rows while none is pinned."""
        now = self.versions.manifest()
        return self.run(now["facts"].get("baseline"), now)

    def history(self) -> DataFrame:
        """The results of all runs."""
        return self.versions.read("runs", RESULTS)
