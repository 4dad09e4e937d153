"""A training corpus from `documents`: drop toxic texts, near copies and benchmark leaks, mix, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the
columns of documents. run() writes each result in the shared folder and reads it again.
Other columns than these aren't read. Null and empty texts pass the first three stages; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquarry.llm.common import sized, stored, words
from sparquarry.llm.decontamination import contamination
from sparquarry.llm.minhash import near_duplicates
from sparquarry.llm.mixing import mixture
from sparquarry.llm.token_output import encoded_corpus
from sparquarry.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids are broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_IDS = 300_000

#: Models, sampled similarity search and token coding are beyond SQL; tests hold run() against the single operators.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject by their language's threshold; each is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit_toxicity(docs, labels), COLUMNS).where("not toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies on five-word shingles.

    Rows that share an id are one document, of which every different text stays once. Rows
    with a null id stay.
    """
    found = stored(near_duplicates(docs, shingle_words=5, percent=80).where("doc_id is not null"), "near")
    gone = stored(found.where("not kept").select("doc_id").distinct(), "dropped")
    left = docs.join(sized(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*COLUMNS)
    often = stored(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    if often.isEmpty():
        return left
    shared = left.join(sized(often, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(sized(often, BROADCAST_IDS), "doc_id", "left_anti").select(*COLUMNS).unionByName(shared)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark; each is judged by its own text."""
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS).where("kept").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one across its source's end once more with its first words.

    Rows without words aren't taken.
    """
    rows = mixture(docs, weights=(1, 2, 3), most=3.0, keep=COLUMNS).where("taken > 0").select("row.*", "size", "taken")
    rest = F.col("taken") % F.col("size")
    pieces = F.array_repeat(F.lit(0), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.select(*COLUMNS, F.explode(F.when(rest > 0, F.concat(pieces, F.array(rest.cast("int")))).otherwise(pieces)).alias("first_words"))
    text = F.when(F.col("first_words") > 0, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("first_words")), " ")).otherwise(F.col("text"))
    size = F.when(F.col("first_words") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a token file, read back: start, number and checksum of each document's ids."""
    import public_tokenizers

    back = encoded_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, digests=True)
    return back.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("tokens", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
