"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

A source first gives as many complete epochs as its target holds. The rest of the target
is sampled: each document has an exponential key, scaled by its quality weight, and those
with the smallest keys are taken until their sizes, added up in that order, fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, discard, sized, stored


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of a text's characters that aren't signs or digits; 0.1 without text."""
    text = F.coalesce(text, F.lit(""))
    odd = F.regexp_count(text, F.lit(r"[!-&*+/-9<-@\[-`{-~]"))
    return F.greatest(F.lit(0.1), F.when(F.length(text) > 0, 1 - odd / F.length(text)).otherwise(F.lit(0.1)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size, target for each row of sizes (source, source_size); repeating weights by code point, null last.

    The whole size is shared by weight; no target exceeds most times its source's size,
    and what is cut off is shared anew by weight among the others. A source is cut if
    size / weight is under the final share of a weight, so after sorting by that ratio
    the cut ones come first and running sums find where they end.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("at", F.row_number().over(by_name) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    w = W.orderBy("ratio", "at")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    run = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    run = run.withColumn("all", F.sum("source_size").over(W.partitionBy()).cast("double"))
    run = run.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open_weight", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
    # What a weight would get if all sources before this one were cut and none from it on.
    run = run.withColumn("share", (F.col("all") - F.col("capped")) / F.col("open_weight"))
    run = run.withColumn("is_cut", F.col("ratio") < F.col("share"))
    final = run.withColumn("level", F.min(F.when(~F.col("is_cut"), F.struct("ratio", "at", "share"))).over(W.partitionBy()))
    return final.select("source", "source_size", F.when(F.col("is_cut") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level.share") * F.col("weight")).alias("target"))


def sampling_key(seed: int, identity: Column, text: Column, value: Column) -> Column:
    """An exponential deviate over a weight, from a hash of id and text as a number above 0 and below 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(identity.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / value


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, bins: int = 4096, seed: int = 17, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target and taken, the words that the mix takes (and row, a struct of the keep columns).

    Size is the number of words. In each epoch a document is taken whole, but for the one
    across the end of its source's target, which gives its words up to there. So a source
    takes its target, rounded down, and no document exceeds most times its size, rounded
    up to whole epochs. weight (a column of docs, above 0) replaces quality_weight. Keys come
    from a hash of id and text, so reruns agree; copies with one id have one key and are taken
    one after another. Null or blank texts have size 0 and take 0; a null source is a source
    of its own, named last; null ids are ordinary. Other columns aren't read. A source without
    any words has target 0. An empty table gives an empty result.

    No task orders a source: the key at which its rest ends is found by cutting the range of
    its keys into bins, adding up sizes by bin and going on within the bin where the rest
    ends, until that holds one key. How keys are spread changes the number of rounds alone.
    """
    value = quality_weight(F.col(f"`{text_col}`")) if weight is None else weight
    identity, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    keyed = stored(docs.select(identity.alias("id"), source.alias("source"), size.alias("size"), sampling_key(seed, identity, text, value).alias("key"), F.monotonically_increasing_id().alias("nth"), *row), "keys")

    per_source = stored(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi")), "sources")
    # One row a source; sources are few beside their rows.
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("want", F.greatest(F.lit(0.0), F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    plan = stored(targets.join(per_source.select(F.col("source").alias("s_"), "lo", "hi"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_"), "targets")

    def with_plan(df: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
        own = sized(of.withColumnRenamed("source", "s_"))
        return df.join(own, F.col("source").eqNullSafe(F.col("s_")), how).drop("s_")

    ends = stored(plan.where("want > 0").select("source", "want", F.lit(0).cast("long").alias("start"), "lo", "hi"), "ends")
    while not ends.where("lo < hi").isEmpty():
        inside = with_plan(keyed.select("source", "size", "key"), ends.where("lo < hi")).where("key between lo and hi")
        binned = inside.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
        by_bin = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("want").alias("want"), F.first("start").alias("start"))
        upto = by_bin.withColumn("upto", F.col("start") + F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")))
        cut = upto.where("upto >= want and upto - bin_size < want").select("source", "want", (F.col("upto") - F.col("bin_size")).alias("start"), "lo", "hi")
        after = stored(cut.union(ends.where("lo = hi")), "ends")
        discard(ends)
        ends = after

    # Rows with the key of the end, copies of one document but for chance, go by their place: parts first, then within.
    last = ends.select("source", "want", "start", F.col("lo").alias("cut"))
    tied = stored(with_plan(keyed, last).where("key = cut").withColumn("part", F.shiftright("nth", 33)), "tied")
    parts = tied.groupBy("source", "part").agg(F.sum("size").alias("s"))
    before = parts.select(F.col("source").alias("s_"), F.col("part").alias("p_"), (F.sum("s").over(W.partitionBy("source").orderBy("part")) - F.col("s")).alias("before"))
    placed = tied.join(before, F.col("source").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("p_")))
    within = F.sum("size").over(W.partitionBy("source", "part").orderBy("nth"))
    placed = placed.withColumn("upto", F.col("start") + F.col("before") + within)
    more = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("want") - F.col("upto") + F.col("size")))
    placed = placed.select("source", "id", "size", more.alias("more"), *(["row"] if keep else []))
    others = with_plan(keyed, last, "left").where("cut is null or key <> cut")
    others = others.select("source", "id", "size", F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")).alias("more"), *(["row"] if keep else []))
    shares = stored(plan.select("source", "source_size", "target", "epochs"), "shares")
    out = with_plan(others.union(placed), shares)
    discard(per_source, plan)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("more")).alias("taken"), *(["row"] if keep else []))
