"""Sources and sinks: manifests, archives, event and fact files, logs, index tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import trim
from ..operators.evaluate import CASES

PUSH = "ref string, after string, repository struct<full_name:string,default_branch:string>, installation struct<id:bigint>, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
CI_RUN = "action string, workflow_run struct<id:bigint,run_attempt:int,conclusion:string,name:string,head_branch:string,head_sha:string>, repository struct<full_name:string>"
INSTALLATION = "action string, installation struct<id:bigint>, repositories_added array<struct<full_name:string>>, repositories_removed array<struct<full_name:string>>"
JOBS = "jobs array<struct<id:bigint,name:string,conclusion:string,steps:array<struct<name:string,conclusion:string,number:int>>>>"
CHANGES = "files array<struct<filename:string,status:string,additions:int,deletions:int,patch:string>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path: path, size, modified; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """path, content as text; of the wanted paths only, which are joined before contents are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if wanted is not None:
        files = files.join(wanted.select("path"), "path", "left_semi")
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for archives in batches:
        for a in archives.itertuples(index=False):
            rows = []
            with tarfile.open(fileobj=io.BytesIO(a.content), mode="r:*") as tar:
                for m in tar:
                    if m.isfile() and "/" in m.name:
                        rows.append((a.path, m.name.split("/", 1)[1], tar.extractfile(m).read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, path (without its first folder), content of every file in many tar archives, one archive a row of work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "archive string, path string, content string")


def events(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """JSON lines with a declared schema, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("multiLine", True).json(path)


def symbol_facts(raw: DataFrame, repo: str = "repo_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, references, rejects) from a column json of fact documents with camelCase or snake_case names.

    Blank strings are null, lines below 1 are null, the last line defaults to the first,
    unknown kinds and roles to unknown and reference, ids to a hash of their coordinates;
    references to unknown symbols are rejected.
    """
    v = raw.withColumn("v", F.try_parse_json("json"))

    def s(x: str, *names: str):
        found = F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in names])
        return F.when(trim(found) != "", trim(found))

    def n(x: str, *names: str):
        found = F.coalesce(*[F.try_variant_get(x, f"$.{m}", "int") for m in names])
        return F.when(found >= 1, found)

    def each(name: str) -> DataFrame:
        return v.select(repo, F.explode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("x"))

    sym = each("symbols").select(repo, s("x", "id", "symbolId", "symbol_id").alias("given"), s("x", "symbol").alias("symbol"), s("x", "displayName", "display_name").alias("display_name"), F.coalesce(s("x", "kind"), F.lit("unknown")).alias("kind"), s("x", "path").alias("path"), n("x", "startLine", "start_line").alias("start_line"), n("x", "endLine", "end_line").alias("end"))
    ok = F.col("symbol").isNotNull() & F.col("path").isNotNull() & F.col("start_line").isNotNull()
    symbols = sym.where(ok).select(F.coalesce("given", stable_id(F.col(repo), F.col("symbol"), F.col("path"), F.col("start_line"))).alias("symbol_id"), repo, "symbol", F.coalesce("display_name", "symbol").alias("display_name"), "kind", "path", "start_line", F.coalesce("end", "start_line").alias("end_line"))
    ref = each("references").select(repo, s("x", "symbolId", "symbol_id").alias("symbol_id"), F.coalesce(s("x", "role"), F.lit("reference")).alias("role"), s("x", "path").alias("path"), n("x", "startLine", "start_line").alias("start_line"), n("x", "endLine", "end_line").alias("end"), s("x", "enclosingSymbol", "enclosing_symbol").alias("enclosing_symbol"))
    good = ref.where("symbol_id is not null and path is not null and start_line is not null").withColumn("end_line", F.coalesce("end", "start_line")).drop("end")
    known = good.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    rejects = sym.where(~ok).select(repo, F.lit("symbol").alias("kind"), F.to_json(F.struct("symbol", "path")).alias("row")).union(good.join(symbols.select("symbol_id"), "symbol_id", "left_anti").select(repo, F.lit("reference").alias("kind"), F.to_json(F.struct("symbol_id", "path")).alias("row")))
    return symbols, known, rejects


def search_responses(raw: DataFrame) -> DataFrame:
    """Line hits from a column json of exact-search answers of two shapes; score 0.85 and line 1 by default."""
    v = raw.withColumn("v", F.try_parse_json("json"))
    keep = [c for c in raw.columns if c != "json"]

    def get(x: str, kind: str, *names: str):
        return F.coalesce(*[F.try_variant_get(x, f"$.{n}", kind) for n in names])

    flat = v.select(*keep, F.explode(F.coalesce(*[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in ("matches", "Matches", "results")])).alias("m"))
    flat = flat.select(*keep, get("m", "string", "repo", "repository", "Repository").alias("repo"), get("m", "string", "path", "file", "fileName", "FileName").alias("path"), get("m", "int", "line", "lineNumber", "LineNum").alias("line"), get("m", "string", "snippet", "content", "Line").alias("snippet"), get("m", "double", "score", "Score").alias("score"))
    files = v.select(*keep, F.explode(F.coalesce(*[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in ("Result.Files", "result.files", "result.FileMatches")])).alias("f"))
    lines = files.select(*keep, "f", F.explode(F.coalesce(*[F.try_variant_get("f", f"$.{n}", "array<variant>") for n in ("Matches", "matches", "LineMatches")])).alias("m"))
    deep = lines.select(*keep, get("f", "string", "Repository", "repo", "repository").alias("repo"), get("f", "string", "FileName", "path", "fileName").alias("path"), get("m", "int", "LineNum", "lineNumber", "LineNumber", "line").alias("line"), get("m", "string", "Line", "line_text", "snippet").alias("snippet"), get("m", "double", "Score", "score").alias("score"))
    both = flat.unionByName(deep).where("repo is not null and path is not null")
    return both.select(*keep, "repo", "path", F.coalesce("line", F.lit(1)).alias("start_line"), F.coalesce("line", F.lit(1)).alias("end_line"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("score", F.lit(0.85)).alias("score"))


def logs(spark: SparkSession, path: str, last_chars: int = 2_000_000) -> DataFrame:
    """file, log: whole text files, the last characters of long ones."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.right("value", F.lit(last_chars)).alias("log"))


def failed_steps(raw: DataFrame) -> DataFrame:
    """run_id, job_id, name, steps: the failed jobs of a column json and the names of their failed steps."""
    jobs = raw.select("run_id", F.explode(F.from_json("json", JOBS)["jobs"]).alias("j")).where("j.conclusion = 'failure'")
    return jobs.select("run_id", F.col("j.id").alias("job_id"), F.col("j.name").alias("name"), F.transform(F.filter("j.steps", lambda s: s["conclusion"] == "failure"), lambda s: s["name"]).alias("steps"))


def change_files(raw: DataFrame) -> DataFrame:
    return raw.select("change_id", F.explode(F.from_json("json", CHANGES)["files"]).alias("f")).select("change_id", "f.*")


def conversation_roles(messages: DataFrame, bot: str) -> DataFrame:
    """Messages (conv_id, turn, user, subtype, text) with a role; system messages and blank ones are left out."""
    system = ["channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "pinned_item", "unpinned_item"]
    kept = messages.where(~F.coalesce("subtype", F.lit("")).isin(system) & (trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("role", F.when((F.col("user") == bot) | (F.col("subtype") == "bot_message"), "assistant").otherwise("user"))


def write_index(tables: dict[str, DataFrame], path: str, version: str, buckets: int = 64) -> None:
    """All tables of an index version, dealt into buckets by repo; files come last, as their presence means that the rest is there."""
    for name in sorted(tables, key=lambda n: n == "files"):
        df = tables[name].withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
        df.repartition("repo_bucket").write.partitionBy("repo_bucket").parquet(f"{path}/{version}/{name}")
