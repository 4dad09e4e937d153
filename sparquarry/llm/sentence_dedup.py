"""Substring dedup by sliding spans of sentences.

Every run of so many consecutive sentences is hashed and the hashes are joined over all
documents. Sentences that a repeated run covers are removed everywhere but at the run's
first place. Repeated runs that overlap make up a stretch, which may be asked to have a
least number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, sized, stored

#: A sentence ends after a full stop, exclamation or question mark before white space, or with its line.
SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)\s*")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text with the white space after them; leading white space belongs to none."""
    return SENTENCE.findall(text or "")


def runs(found: list[str], least: int) -> list[int]:
    """The hash of every run of least sentences, by the run's first sentence."""
    plain = [s.strip() for s in found]
    return [xxhash.xxh3_64_intdigest("\n".join(plain[i : i + least])) for i in range(len(plain) - least + 1)]


def stretches(starts: list[int], least: int) -> list[tuple[int, int]]:
    """(first sentence, end) of what runs of least sentences cover together if they overlap; starts ascend."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], s + least)
        else:
            out.append((s, s + least))
    return out


def _all_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, hashes, starts = [], [], [], []
            for i, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = runs(sentences(text.as_py()), least)
                ids += [i] * len(own)
                versions += [version] * len(own)
                hashes += own
                starts += range(len(own))
            h = np.array(hashes, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(h, pa.int64()), pa.array(starts, pa.int32())], ["id", "version", "h", "start"])

    return run


def _without(least: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed, firsts = [], [], [], []
            for text, late in zip(batch.column(1), batch.column(2), strict=True):
                text, late = text.as_py(), late.as_py() or []
                found = sentences(text)
                first_doc = {x["start"]: x["first_doc"] for x in late}
                drop, keepers = np.zeros(len(found), bool), set()
                for s, end in stretches(sorted(first_doc), least):
                    if not least_words or sum(len(x.split()) for x in found[s:end]) >= least_words:
                        drop[s:end] = True
                        keepers.update(first_doc[i] for i in range(s, end - least + 1) if first_doc.get(i) is not None)
                totals.append(len(found))
                removed.append(int(drop.sum()))
                firsts.append(sorted(keepers) if drop.any() else None)
                texts.append("".join(s for s, d in zip(found, drop, strict=True) if not d) if drop.any() else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["id", "n_sentences", "n_removed", "first_docs", "text"])

    return run


def _same_row(of: str) -> Column:
    """Whether a row is the one that of's i_ and v_ name; ids may be null."""
    return F.col("id").eqNullSafe(F.col(f"{of}.i_")) & F.col("version").eqNullSafe(F.col(f"{of}.v_"))


def drop_repeated_spans(docs: DataFrame, least: int = 2, least_words: int = 0, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_sentences, n_removed, first_docs, kept, text.

    Every run of least sentences is hashed. Of equal runs the first stays: in the row with the
    smallest id, rows with a null id last, of those with one id the one whose text has the smaller
    hash, there the earliest. All others are late, and the sentences that they cover are removed
    from text. Late runs that share sentences are one stretch, whose runs may be from several rows;
    with least_words, only stretches of so many words are removed. first_docs are the ids of the
    rows that have the first places of what was removed here, without null ids; kept is whether any
    sentence is left of a text that had some.

    A null or blank text has no sentences, is returned as it is and kept. Rows that share an id, or
    have none, are rows like all others: what repeats between them is removed from the later one. Of
    rows equal in id and text one counts as the first, and the others lose all that is in whole runs.
    Other columns aren't read. An empty table gives an empty result. Work grows with the number of
    sentences; a run that a third of all rows share is counted before it is shuffled, and its
    occurrences are joined by broadcast or by a join that Spark splits.
    """
    read = pick(docs, [id_col, text_col]).toDF("id", "text").withColumn("version", F.xxhash64("text"))
    every = stored(read.select("id", "version", "text").mapInArrow(_all_runs(least), "id long, version long, h long, start int"), "runs")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("doc"), "version", "start")
    repeated = stored(every.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("h", "first"), "repeated")
    met = every.join(sized(repeated, broadcast_rows), "h").withColumn("late", place != F.col("first"))

    def by_row(found: DataFrame) -> DataFrame:
        # As many runs as the text has sentences at most.
        runs_ = F.collect_set(F.struct("start", F.col("first.doc").alias("first_doc"))).alias("late")
        return found.groupBy(F.col("id").alias("i_"), F.col("version").alias("v_")).agg(runs_)

    drops = stored(by_row(met.where("late")), "drops")
    twins = stored(read.groupBy(F.col("id").alias("i_"), F.col("version").alias("v_")).agg(F.count("*").alias("c")).where("c > 1").select("i_", "v_"), "twins")
    if twins.isEmpty():
        joined = read.join(drops.alias("d"), _same_row("d"), "left").select("id", "text", "late")
    else:
        alone = read.join(sized(twins).alias("t"), _same_row("t"), "left_anti").join(drops.alias("d"), _same_row("d"), "left").select("id", "text", "late")
        # Equal rows, told apart by their places in a table of them: all runs of any but the first are late.
        copies = stored(read.join(sized(twins).alias("t"), _same_row("t"), "left_semi").withColumn("nth", F.monotonically_increasing_id()), "copies")
        first = copies.groupBy(F.col("id").alias("i_"), F.col("version").alias("v_")).agg(F.min("nth").alias("first_nth"))
        marked = copies.join(F.broadcast(first).alias("f") if twins.count() <= broadcast_rows else first.alias("f"), _same_row("f")).withColumn("again", F.col("nth") != F.col("first_nth")).drop("i_", "v_")
        whole = by_row(met.join(sized(twins).alias("t"), _same_row("t"), "left_semi"))
        late = stored(drops.withColumn("again_", F.lit(False)).unionByName(whole.withColumn("again_", F.lit(True))), "drops")
        joined = alone.unionByName(marked.join(late.alias("d"), _same_row("d") & (F.col("again") == F.col("again_")), "left").select("id", "text", "late"))
    out = joined.mapInArrow(_without(least, least_words), "id long, n_sentences long, n_removed long, first_docs array<long>, text string")
    discard(every, repeated)
    kept = (F.col("n_sentences") == 0) | (F.col("n_removed") < F.col("n_sentences"))
    return out.select(F.col("id").alias(id_col), "n_sentences", "n_removed", "first_docs", kept.alias("kept"), F.col("text").alias(text_col))
