"""Index tables derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_lines

WINDOW, OVERLAP = 10, 2


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select(
        F.concat("source", F.lit(":"), doc).alias("file_id"), F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), doc, F.lit(".txt")).alias("path"), F.lit("text").alias("language"), F.sha2("text", 256).alias("blob_sha"), F.col("n_chars").alias("size"), F.col("text").alias("content"), "doc_id"
    )


FILES = "files_ AS (SELECT source || ':' || doc_id AS file_id, source AS repo_id, lang || '/' || doc_id || '.txt' AS path, sha256(text) AS blob_sha, n_chars AS size, text AS content, doc_id FROM documents)"


def old_files(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot before: some files missing, some different."""
    f = files(spark, d).where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit("\nold"))).otherwise(F.col("content")))
    return f.withColumn("blob_sha", F.sha2("content", 256))


def new_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("doc_id % 7 <> 0")


SNAPSHOTS = FILES + ", old_f AS (SELECT * REPLACE (sha256(content) AS blob_sha) FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN content || chr(10) || 'old' ELSE content END AS content) FROM files_ WHERE doc_id % 10 <> 0)), new_f AS (SELECT * FROM files_ WHERE doc_id % 7 <> 0)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_lines(files(spark, d), WINDOW, OVERLAP)


def chunks_sql(of: str = "files_", name: str = "chunks_") -> str:
    """The line windows of a files CTE, as another CTE."""
    step = WINDOW - OVERLAP
    return f"""{name}_l AS (SELECT repo_id, path, string_split(content, chr(10)) AS lines, len(string_split(content, chr(10))) AS n FROM {of}),
{name}_a AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - {WINDOW}) / {step}.0)) AS BIGINT) * {step} + 1, {step})) AS at_ FROM {name}_l),
{name}_r AS (SELECT repo_id, path, CAST(at_ + 1 AS INT) AS start_line, CAST(least(at_ + {WINDOW}, n) AS INT) AS end_line,
  substr(regexp_replace(array_to_string(lines[at_ + 1 : at_ + {WINDOW}], chr(10)), '^\\s+|\\s+$', '', 'g'), 1, 8000) AS content FROM {name}_a),
{name} AS (SELECT sha256(concat_ws(chr(0), repo_id, path, 'generic', start_line, end_line, '')) AS chunk_id, repo_id, path, start_line, end_line, content, sha256(content) AS content_hash FROM {name}_r WHERE content <> '')"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("to_symbol"))
    return read(spark, d, "lineitem").join(part, "l_partkey").select(F.lit("r").alias("repo_id"), F.col("l_orderkey").alias("from_node"), F.lit("CALLS").alias("edge_type"), "to_symbol", F.col("l_linenumber").alias("line"))


EDGES = "edges_ AS (SELECT l_orderkey AS from_node, p_name AS to_symbol, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey)"


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.lit("r").alias("repo_id"), F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("display_name"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of five sources on parts, by supplier: candidates to merge."""
    names = F.array(*[F.lit(s) for s in ("symbol", "exact", "vector", "lexical", "graph")])
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.lit("r").alias("repo_id"), F.get(names, (F.col("l_linenumber") % 5).cast("int")).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.round(F.col("l_discount") * 5 + F.col("l_tax"), 6).alias("score"))


HITS = "hits_ AS (SELECT l_suppkey % 50 AS query_id, l_partkey AS chunk_id, l_linenumber % 5 AS s, (['symbol','exact','vector','lexical','graph'])[1 + l_linenumber % 5] AS source, l_orderkey * 10 + l_linenumber AS ord, round(l_discount * 5 + l_tax, 6) AS score FROM lineitem)"
