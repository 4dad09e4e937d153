"""What the two text classifiers share: the bounded labelled sample and held-out marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A document whose crc32(id as text) leaves 0 by this is never learned from.
FOLDS = 5


def held_out(id_col: str) -> Column:
    """Whether a document may not be learned from; a null id never may."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, with_lang: bool = False, most_chars: int = 64_000_000) -> pd.DataFrame:
    """At most bound documents of either label, to fit a model on: doc_id, label, text (, lang), weight.

    Rows are picked by the hash of their id among all labelled ones outside the held-out
    fold, so that reruns agree, and as long as the texts of their label picked before have
    under most_chars characters: what the driver gets is bounded, but for one last text of
    either label. weight restores each label's share. Only the ids are joined by broadcast,
    2 * bound at most. Of rows that share an id the greatest text counts. Null labels, ids
    and texts are left out.
    """
    usable = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    columns = ["text", *(["lang"] if with_lang else [])]
    found = docs.select("doc_id", F.struct(*columns).alias("r")).where("r.text is not null").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.max("r").alias("r"))
    # Both labels have bound rows at most.
    before = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum(F.length("r.text")).over(before), F.lit(0))).where(F.col("before") < most_chars)
    rows = found.select("doc_id", *[f"r.{c}" for c in columns], "label").toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
    rows["weight"] = rows["label"].map({k: max(1.0, n / bound) for k, n in sizes.items()})
    return rows
