"""Benchmark decontamination by spaced seeds, in DataFrame operations.

Fixed masks slide over the tokens of documents and of benchmark items; a mask's hash
leaves out some positions, so that a replaced word there doesn't matter. Equal hashes are
hits. Around each hit the two token sequences are laid side by side and compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, pick, sized, stored

#: From so many tokens of an item, its masks; 1: the token counts, 0: any token may stand there. However a fifth of
#: an item's tokens, or of 16 in a row of a longer one, are replaced, some mask fits between them (see the tests).
MASKS = (
    (5, ("1111", "11011", "11101", "10111")),
    (10, ("11101", "1000001011")),
    (15, ("11101011", "11001000111", "10110010011")),
)


#: A text of fewer tokens than any mask can be found by is one window as a whole.
WHOLE = ""


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def windows(df: DataFrame, keys: list[str], masks: Iterable[str], least_tokens: int, width: int) -> DataFrame:
    """keys, at, hash for each window of each mask over the tokens t; WHOLE takes texts of under least_tokens tokens.

    Masks become rows of width offsets (the last place is repeated), so that one
    expression hashes every window and rows without a partner are gone before anything is copied.
    """
    places = [(no, len(m) or 1, [i for i, c in enumerate(m) if c == "1"] or list(range(least_tokens - 1))) for no, m in enumerate(masks)]
    table = F.array(*[F.struct(F.lit(int(f"1{m}", 2)).alias("seed"), F.lit(not m).alias("whole"), F.lit(n).alias("length"), *[F.lit((at + at[-1:] * width)[j]).alias(f"o{j}") for j in range(width)]) for m, (_, n, at) in zip(masks, places, strict=True)])
    hashed = df.select(*keys, F.transform("t", lambda w: F.xxhash64(w)).alias("h"))
    by_mask = hashed.select(*keys, "h", F.explode(table).alias("m"))
    n = F.size("h")
    starts = F.when(F.col("m.whole"), F.when((n > 0) & (n < least_tokens), F.array(F.lit(0)))).when(n >= F.col("m.length"), F.sequence(F.lit(0), n - F.col("m.length")))
    each = by_mask.select(*keys, "h", "m", F.explode(starts).alias("at"))
    return each.select(*keys, "at", F.xxhash64("m.seed", *[F.get("h", F.col("at") + F.col(f"m.o{j}")) for j in range(width)]).alias("hash"))


def _best_window(same: Column, length: Column) -> Column:
    """The most 1s in any length neighbours of an array of 0 and 1."""
    add = lambda a, x: a + x
    sums = F.transform(F.sequence(F.lit(1), F.size(same) - length + 1), lambda i: F.aggregate(F.slice(same, i, length), F.lit(0), add))
    return F.when(F.size(same) >= length, F.array_max(sums)).otherwise(F.lit(0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 16, percent: int = 80, least_tokens: int = 5, masks: tuple[tuple[int, tuple[str, ...]], ...] = MASKS, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, contaminated, kept, items, overlap (and row, a struct of the keep columns).

    A document is contaminated if it holds window tokens in a row of which percent at least
    are those of an item at the same places, with a hit of a mask on that diagonal; an item
    of fewer tokens must be there as a whole, with percent of its tokens at least. With the
    window and percent given here, masks have a hit on every such diagonal. An item of under
    least_tokens tokens says too little within a text: it is found where it is the whole text.
    items are the ids found, overlap the best share of equal tokens.

    Null or blank texts and items match nothing. Repeated rows are judged alike, rows that
    share an id by their own texts; null ids are ordinary. Other columns aren't read. Empty
    tables give an empty or a clean result. The benchmark's hashes are broadcast up to
    broadcast_rows rows and a size in bytes, else both sides are shuffled by hash.
    """
    version = F.xxhash64("text").alias("version")
    read = pick(docs, [id_col, text_col]).toDF("id", "text").select("id", "text", version)
    items = stored(pick(benchmark, ["item_id", "text"]).select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0).distinct(), "items")
    # Items by the masks of their lengths; documents have those masks that some item has.
    bands = [(own, F.size("t").between(low, high - 1)) for (low, own), (high, _) in pairwise([(1, (WHOLE,)), *masks, (1 << 31, ())])]
    lengths = items.select(*[F.count_if(fits).alias(f"n{k}") for k, (_, fits) in enumerate(bands)]).first()
    bands = [band for band, n in zip(bands, lengths, strict=True) if n] or bands[-1:]
    width = max(least_tokens - 1, *(m.count("1") for own, _ in bands for m in own))
    seeds = None
    for own, fits in bands:
        more = windows(items.where(fits), ["item_id"], own, least_tokens, width)
        seeds = more if seeds is None else seeds.union(more)
    every = list(dict.fromkeys(mask for own, _ in bands for mask in own))
    found = windows(read.select("id", "version", tokens(F.col("text")).alias("t")), ["id", "version"], every, least_tokens, width)
    seeds = stored(seeds.distinct(), "seeds")
    hits = found.join(sized(seeds.withColumnRenamed("at", "item_at"), broadcast_rows), "hash")
    hits = stored(hits.select("id", "version", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).distinct(), "hits")

    # Only documents with hits are read again; each diagonal is compared along the whole item.
    hit_docs = stored(hits.select(F.col("id").alias("i_"), F.col("version").alias("v_")).distinct(), "hit_docs")
    same_doc = F.col("id").eqNullSafe(F.col("i_")) & (F.col("version") == F.col("v_"))
    texts = read.join(sized(hit_docs, broadcast_rows), same_doc, "left_semi").dropDuplicates(["id", "version"]).select(F.col("id").alias("i_"), F.col("version").alias("v_"), tokens(F.col("text")).alias("doc_t"))
    laid = sized(hits, broadcast_rows).join(texts, same_doc).join(sized(items, broadcast_rows), "item_id")
    first = F.greatest(F.lit(0), -F.col("offset"))
    count = F.least(F.size("t"), F.size("doc_t") - F.col("offset")) - first
    part = laid.select("id", "version", "item_id", F.size("t").alias("n"), F.slice("t", first + 1, count).alias("x"), F.slice("doc_t", first + F.col("offset") + 1, count).alias("y"))
    same = F.zip_with("x", "y", lambda a, b: (a == b).cast("int"))
    length = F.least(F.lit(window), F.col("n"))
    best = part.select("id", "version", "item_id", length.alias("length"), let(same, lambda s: _best_window(s, length)).alias("best"))
    bad = best.where(100 * F.col("best") >= percent * F.col("length")).groupBy("id", "version").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("best") / F.col("length")).alias("overlap"))
    bad = stored(bad.select(F.col("id").alias("i_"), F.col("version").alias("v_"), "items", "overlap"), "contaminated")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("version"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []))
    out = rows.join(sized(bad, broadcast_rows), same_doc, "left")
    discard(items, seeds, hits, hit_docs)
    flagged = F.col("items").isNotNull()
    return out.select(F.col("id").alias(id_col), flagged.alias("contaminated"), (~flagged).alias("kept"), "items", "overlap", *(["row"] if keep else []))
