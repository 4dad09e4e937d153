"""Searches of many queries at once over the chunk index: full text, vectors, exact text, symbols, call graph.

Hits have query_id, chunk_id, score, source and ord, their place in the source's list.
No search joins on a bare prefix, suffix or substring: each goes through a vocabulary,
a trigram or a last-segment key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.stored import stored
from .fulltext import FIELDS, TextIndex, phrase_count, tokens

K1, B = 1.2, 0.75
DEFINITION_TYPES = ["function", "method", "class", "struct", "type", "interface"]


def top(df: DataFrame, k: int, by: list, key: str | list[str] = "query_id") -> DataFrame:
    """The first k rows of each key, numbered by ord; plans as a limit by window before the shuffle."""
    return df.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col("ord") <= k)


def shared(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of what queries ask for: sent to all tasks up to so many rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_scope(hits: DataFrame, scopes: DataFrame | None) -> DataFrame:
    """Hits of repos that the query may see; a query without scope rows sees nothing. None: no limits."""
    return hits if scopes is None else hits.join(scopes.select("query_id", "repo_id").distinct(), ["query_id", "repo_id"], "left_semi")


def bm25_search(queries: DataFrame, index: TextIndex, scopes: DataFrame | None = None, k: int = 25, weights: tuple[float, float, float] = (8.0, 4.0, 1.0), chunks: DataFrame | None = None) -> DataFrame:
    """Best k chunks of each query (query_id, needles, symbols) by BM25 over any of its prefix phrases.

    A needle is a run of tokens of which the last may go on. Its tokens are found one by one,
    the last through the vocabulary, and must stand side by side. What a needle is worth in a
    chunk is worked out once, however many queries have it; queries meet needles after that, chunk by
    chunk. The score is relative to the query's best hit, with a little more where chunks (chunk_id, symbol)
    has a symbol that the query names.
    """
    asked = queries.select("query_id", F.explode(F.transform("needles", tokens)).alias("t")).where(F.size("t") > 0)
    asked = asked.select("query_id", F.array_join("t", " ").alias("needle"), "t")
    each = asked.select("needle", "t").dropDuplicates(["needle"])
    words = each.select("needle", F.size("t").alias("n"), F.posexplode("t").alias("i", "word"))
    # Last words meet the terms that begin like them, by up to four characters.
    keyed = index.terms.withColumn("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring("term", F.lit(1), n)))))
    lasts = words.where("i = n - 1").withColumn("key", F.substring("word", 1, 4))
    expanded = lasts.join(keyed, "key").where(F.col("term").startswith(F.col("word"))).select("needle", "n", "i", "term").distinct()
    wanted = shared(stored(expanded.union(words.where("i < n - 1").select("needle", "n", "i", F.col("word").alias("term"))), "wanted"))
    weight = F.when(F.col("field") == "symbol", weights[0]).when(F.col("field") == "path", weights[1]).otherwise(weights[2])
    # Postings of other terms are left out before they are counted; where chunks are dealt out by id, no posting is shuffled.
    held = index.postings.join(shared(stored(wanted.select("term").distinct(), "words")), "term", "left_semi").join(wanted, "term")
    tf = held.where("n = 1").groupBy("chunk_id", "repo_id", "needle").agg(F.sum(weight * F.col("tf")).alias("tf"))
    if not each.where(F.size("t") > 1).isEmpty():
        # Chunks that have all words of a longer needle in a field: only their texts are read.
        both = held.where("n > 1").groupBy("needle", "n", "chunk_id", "repo_id", "field").agg(F.count_distinct("i").alias("m")).where("m = n")
        texts = index.chunks.select("chunk_id", *FIELDS)
        field = F.when(F.col("field") == "symbol", F.col("symbol")).when(F.col("field") == "path", F.col("path")).otherwise(F.col("content"))
        whole = both.join(each, "needle").join(texts, "chunk_id").withColumn("times", phrase_count(field, F.col("t"))).where("times > 0")
        tf = tf.unionByName(whole.groupBy("chunk_id", "repo_id", "needle").agg(F.sum(weight * F.col("times")).alias("tf")))
    docs, total = index.sums()
    # A row a chunk: what follows works on a chunk's own needles, and only the best of each task leave it.
    found = tf.groupBy("chunk_id", "repo_id").agg(F.collect_list(F.struct("needle", "tf")).alias("found"))
    found = stored(found.join(index.lengths.select("chunk_id", "length"), "chunk_id"), "tf")
    df = found.select(F.explode("found.needle").alias("needle")).groupBy("needle").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = total / docs if docs else 1.0
    asking = shared(stored(asked.select("query_id", "needle").join(df.select("needle", idf.alias("idf")), "needle"), "asking"))
    worth = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = found.repartition("chunk_id").select("chunk_id", "repo_id", "length", F.inline("found")).join(asking, "needle")
    ranked = in_scope(scored.groupBy("query_id", "chunk_id", "repo_id").agg(F.sum(worth).alias("bm25")), scopes)
    best = top(ranked, k, [F.desc(F.round("bm25", 9)), "chunk_id"])
    high = F.greatest(F.max("bm25").over(W.partitionBy("query_id")), F.lit(1e-6))
    best = best.withColumn("score", 0.35 + 0.5 * F.col("bm25") / high)
    if chunks is not None and "symbols" in queries.columns:
        # The best chunks are kept, so that their symbols are looked up without searching again.
        best = stored(best, "best")
        named = best.select("query_id", "chunk_id").join(chunks.select("chunk_id", "symbol").where("symbol is not null"), "chunk_id").join(queries.select("query_id", "symbols"), "query_id")
        named = named.where(F.array_contains("symbols", F.col("symbol"))).select("query_id", "chunk_id", F.lit(0.1).alias("more"))
        best = best.join(named, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    return best.withColumn("score", F.least(F.lit(0.95), "score")).withColumn("source", F.lit("lexical"))


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder: signed hashed words, scaled to length 1; 0 for texts without words."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for r, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[r, h % dims] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], np.ndarray], batch: int = 96) -> DataFrame:
    """(id, embedding) by a function from texts to vectors; rows with an empty vector are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                v = embedder(part[text_col].tolist())
                yield pd.DataFrame({id_col: part[id_col], "embedding": [x if np.any(x) else None for x in v]}).dropna(subset=["embedding"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, each summed up in the order of its values, as SQL does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _cosines(q: np.ndarray, own: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of rows to six digits, halves upwards; own: squares of q's lengths. 0 to a vector of zeros.

    The last bit of a sum depends on its order. Only pairs so near to a half of the last digit that it matters are summed up again one by one.
    """
    lengths = np.sqrt(own[:, None] * _dots(v, v)[None, :])
    lengths[lengths == 0] = np.inf
    at = q @ v.T / lengths * 1e6
    qi, vi = np.nonzero(np.abs(np.abs(at - np.trunc(at)) - 0.5) < 1e-5)
    at[qi, vi] = _dots(q[qi], v[vi]) / lengths[qi, vi] * 1e6
    whole = np.trunc(at)
    return (whole + np.where(np.abs(at - whole) >= 0.5, np.sign(at), 0)) / 1e6


def vector_search(queries: DataFrame, vectors: DataFrame, scopes: DataFrame | None = None, k: int = 30, prefilter: bool = False, block: int = 1024, max_queries: int = 20_000) -> DataFrame:
    """Exact cosine top k of each query (query_id, embedding) over vectors (chunk_id, repo_id, embedding).

    The stated query set, at most max_queries, is sent to every task; a task gives k rows a query,
    however many vectors it reads. Scores are those of double precision; equal ones, to six digits, go by chunk. The scope filter comes
    after the top k, or before it with prefilter.
    """
    if queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: search them in parts")
    rows = queries.select("query_id", "embedding").orderBy("query_id").toPandas()
    allowed = None
    if prefilter and scopes is not None:
        allowed = scopes.select("query_id", "repo_id").distinct().groupBy("query_id").agg(F.collect_set("repo_id").alias("r")).toPandas().set_index("query_id")["r"].map(set).to_dict()
    shared = queries.sparkSession.sparkContext.broadcast((rows["query_id"].tolist(), np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1), allowed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, allow = shared.value
        if not ids:
            return
        own = _dots(q, q)
        least, held, size = np.full(len(ids), -np.inf), [], 0
        step = max(1, min(block, 4_000_000 // len(ids)))  # so many pairs at once, whatever the number of queries

        def cut() -> pd.DataFrame:
            """The best k so far of each query; least becomes what a further hit must reach."""
            best = pd.concat(held).sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q").head(k)
            full = best.groupby("q")["score"].agg(["size", "min"])
            full = full[full["size"] == k]
            least[full.index] = np.maximum(least[full.index], full["min"])
            return best

        for part in batches:
            for i in range(0, len(part), step):
                p = part.iloc[i : i + step]
                sims = _cosines(q, own, np.array(p["embedding"].tolist(), np.float64))
                if allow is not None:
                    sims = np.where([[r in allow.get(x, ()) for r in p["repo_id"]] for x in ids], sims, -np.inf)
                if len(p) > k:
                    least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                qi, vi = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                held.append(pd.DataFrame({"q": qi, "score": sims[qi, vi], "chunk_id": p["chunk_id"].to_numpy()[vi], "repo_id": p["repo_id"].to_numpy()[vi]}))
                size += len(qi)
                if size > 4 * k * len(ids):
                    held = [cut()]
                    size = len(held[0])
        if held:
            best = cut()
            yield pd.DataFrame({"query_id": [ids[x] for x in best["q"]], "chunk_id": best["chunk_id"].to_numpy(), "repo_id": best["repo_id"].to_numpy(), "score": best["score"].to_numpy()})

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("chunk_id", "repo_id")}
    near = vectors.select("chunk_id", "repo_id", "embedding").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_id']}, repo_id {kinds['repo_id']}, score double")
    best = top(near, k, [F.desc(F.round("score", 6)), "chunk_id"])
    return (best if prefilter else in_scope(best, scopes)).withColumn("source", F.lit("vector"))


def _grams(x: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text, lower-cased."""

    def of(c: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))
        return F.when(F.size(c) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(F.split(F.lower(x), ""), of)


def build_trigrams(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id) of the lower-cased contents: the index of exact_search."""
    return chunks.select("chunk_id", F.explode(_grams(F.col("content"))).alias("gram"))


def _all_text() -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce("symbol", F.lit("")), "path", "content"))


def build_grams(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id) of symbol, path and content in runs of one, two and three characters: the index of substring_search."""
    text = _all_text()
    return chunks.select("chunk_id", F.explode(F.concat(*[_grams(text, n) for n in (1, 2, 3)])).alias("gram"))


def _holding(literals: DataFrame, grams: DataFrame, texts: DataFrame) -> DataFrame:
    """(literal, chunk_id, repo_id): which texts (chunk_id, repo_id, text) hold which literals, all lower-cased.

    Candidates share the literal's rarest gram: of three characters, or the literal itself if it
    is shorter. All literals that a text may hold go through it together.
    """
    sized_ = F.when(F.length("literal") >= 3, _grams(F.col("literal"))).otherwise(F.array(F.lower("literal")))
    need = literals.select("literal").distinct().select("literal", F.explode(sized_).alias("gram"))
    known = grams.join(need.select("gram").distinct(), "gram", "left_semi")
    frequency = known.groupBy("gram").agg(F.count("*").alias("df"))
    # A literal with a gram that is nowhere has no hits; an inner join would overlook that gram.
    rarest = need.join(frequency, "gram", "left").groupBy("literal").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(known, "gram").groupBy("chunk_id").agg(F.collect_list("literal").alias("literals"))
    held = candidates.join(texts, "chunk_id").select("chunk_id", "repo_id", F.filter("literals", lambda x: F.contains(F.col("text"), F.lower(x))).alias("literals"))
    return held.select("chunk_id", "repo_id", F.explode("literals").alias("literal"))


def _inside_texts(literals: DataFrame, texts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Which texts (chunk_id, ..., text) hold which literals, all lower-cased, without an index of the texts: all columns but text, and literal.

    A literal is looked for by one key: its longest word, if that ends within the literal, else its
    run of three characters that fewest of terms (term), the distinct words of the texts, have; a shorter one
    is its own key. Texts meet literals by their keys in the tasks that they are dealt out to by chunk_id.
    """
    low, others = F.lower("literal"), [c for c in texts.columns if c != "text"]
    edge = lambda pattern: F.regexp_like(low, F.lit(pattern)).cast("int")
    each = literals.select("literal").distinct().withColumn("t", tokens(low)).withColumn("first", edge(r"^[\p{L}\p{N}]")).withColumn("inner", F.size("t") - F.col("first") - edge(r"[\p{L}\p{N}]$"))
    longest = lambda t: F.element_at(F.array_sort(F.transform(t, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    whole = each.where("inner > 0").select("literal", longest(F.slice("t", F.col("first") + 1, F.greatest("inner", F.lit(1)))).alias("key"))
    rest = each.where("inner <= 0").select("literal", F.length(low).alias("n"))
    sizes = sorted({min(r["n"], 3) for r in rest.select("n").distinct().collect()})  # few numbers
    anchors, keys = whole.union(rest.where("n < 3").select("literal", low.alias("key"))), [tokens(F.col("text")), *[_grams(F.col("text"), n) for n in sizes]]
    if 3 in sizes:
        if terms is None:
            terms = stored(texts.select(F.explode(tokens(F.col("text"))).alias("term")).distinct(), "terms")
        need = rest.where("n >= 3").select("literal", F.explode(_grams(F.col("literal"))).alias("gram"))
        often = terms.select(F.explode(_grams(F.col("term"))).alias("gram")).join(shared(stored(need.select("gram").distinct(), "grams")), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
        # Runs over a word's end aren't known and come last; one within a word that no word has is nowhere.
        unknown = F.when(F.regexp_like("gram", F.lit(r"[^\p{L}\p{N}]")), 2**62).otherwise(0)
        seldom = need.join(often, "gram", "left").groupBy("literal").agg(F.min_by("gram", F.struct(F.coalesce("df", unknown).alias("df"), "gram")).alias("key"))
        anchors = anchors.union(seldom)
    met = texts.select(*others, "text", F.explode(F.array_distinct(F.concat(*keys))).alias("key")).join(shared(stored(anchors, "anchors")), "key")
    return met.where(F.contains("text", low)).select(*others, "literal")


def exact_search(queries: DataFrame, chunks: DataFrame, grams: DataFrame | None = None, scopes: DataFrame | None = None, k: int | None = 20, score: float = 0.85, terms: DataFrame | None = None) -> DataFrame:
    """Chunks that hold any of a query's literals (query_id, needles), without regard to case; first k by chunk, all without k and then without ord.

    grams: as build_trigrams() gives, where they are kept for many searches; without them contents are gone through, with terms (term), their distinct words, if there are any.
    """
    each = stored(queries.select("query_id", F.explode("needles").alias("literal")).where(F.length("literal") >= 3).distinct(), "literals")
    texts = chunks.select("chunk_id", "repo_id", F.lower("content").alias("text"))
    found = _inside_texts(each, texts.repartition("chunk_id"), terms) if grams is None else _holding(each, grams, texts)
    hits = in_scope(found.join(shared(each), "literal"), scopes).groupBy("query_id", "chunk_id", "repo_id").agg(F.count("*").alias("literals"))
    best = hits if k is None else top(hits, k, [F.desc("literals"), "chunk_id"])
    return best.withColumn("score", F.lit(score)).withColumn("source", F.lit("exact"))


def overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{a}.end_line") >= F.col(f"{b}.start_line"))


def _named(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a needle names in full, by display name, or by the end of their path of names."""
    each = queries.select("query_id", F.explode(F.slice("needles", 1, 12)).alias("needle")).distinct()
    last = lambda x: F.lower(F.element_at(F.split(x, r"[^\p{L}\p{N}_]+"), -1))
    names = symbols.select("*", F.explode(F.array_distinct(F.array(last(F.col("symbol")), last(F.coalesce("display_name", "symbol"))))).alias("key"))
    hit = each.withColumn("key", last(F.col("needle"))).join(names, "key")
    same = (F.col("symbol") == F.col("needle")) | (F.col("display_name") == F.col("needle")) | F.lower("symbol").endswith(F.lower("needle"))
    return hit.where(same).drop("key", "needle").distinct()


def definition_search(queries: DataFrame, symbols: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 10, score: float = 0.92) -> DataFrame:
    """Chunks over the lines of the symbols that a query (query_id, needles) names: those that symbols' definition_chunk_id has first, then the shortest."""
    s, c = _named(queries, symbols).alias("s"), chunks.alias("c")
    hit = s.join(c, (F.col("s.repo_id") == F.col("c.repo_id")) & (F.col("s.path") == F.col("c.path")) & overlap("s", "c"))
    rank = F.struct(F.when(F.col("c.chunk_id") == F.col("s.definition_chunk_id"), 0).otherwise(1).alias("kind"), (F.col("c.end_line") - F.col("c.start_line")).alias("span"))
    best = in_scope(hit.groupBy("s.query_id", "c.chunk_id", "c.repo_id").agg(F.min(rank).alias("rank")), scopes)
    return top(best, k, ["rank", "chunk_id"]).select("query_id", "chunk_id", "repo_id", "ord", F.lit(score).alias("score"), F.lit("symbol").alias("source"))


def reference_search(queries: DataFrame, symbols: DataFrame, references: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 12, roles: tuple[str, ...] = ("reference", "implementation", "override"), score: float = 0.72) -> DataFrame:
    """Chunks over the lines that refer to the symbols a query names: lines within some symbol first, then the shortest.

    The first k chunks of a symbol are found once, however many queries name it. Symbols with the same references may share a symbol_id.
    """
    s = _named(queries, symbols).select("query_id", "symbol_id", "repo_id").distinct()
    r, c = references.where(F.col("role").isin(*roles)).join(s.select("symbol_id", "repo_id").distinct(), ["symbol_id", "repo_id"], "left_semi").alias("r"), chunks.alias("c")
    hit = r.join(c, (F.col("r.repo_id") == F.col("c.repo_id")) & (F.col("r.path") == F.col("c.path")) & overlap("r", "c"))
    rank = F.struct(F.when(F.col("r.enclosing_symbol").isNotNull(), 0).otherwise(1).alias("kind"), (F.col("c.end_line") - F.col("c.start_line")).alias("span"))
    first = top(hit.groupBy("r.symbol_id", "r.repo_id", "c.chunk_id").agg(F.min(rank).alias("rank")), k, ["rank", "chunk_id"], ["symbol_id", "repo_id"]).drop("ord")
    best = in_scope(s.join(first, ["symbol_id", "repo_id"]).groupBy("query_id", "chunk_id", "repo_id").agg(F.min("rank").alias("rank")), scopes)
    return top(best, k, ["rank", "chunk_id"]).select("query_id", "chunk_id", "repo_id", "ord", F.lit(score).alias("score"), F.lit("symbol").alias("source"))


def symbol_search(queries: DataFrame, symbols: DataFrame, references: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Definitions, then references and implementations."""
    d = definition_search(queries, symbols, chunks, scopes, k)
    return d.unionByName(reference_search(queries, symbols, references, chunks, scopes, k, ("reference", "implementation")).withColumn("ord", F.col("ord") + k))


def _first_named(defs: DataFrame, k: int, by_repo: bool, name: str = "symbol") -> DataFrame:
    """The first k chunks of each name, or of each name and repo: what a query takes k of by name can't hold others."""
    return top(defs.select(name, "chunk_id", "repo_id").distinct(), k, ["chunk_id"], [name, "repo_id"] if by_repo else [name])


def callers(asked: DataFrame, edges: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 8, score: float = 0.5) -> DataFrame:
    """Chunks with a call to asked (query_id, symbol).

    Calls are cut to the first k of a symbol, by repo under scopes, before queries meet them.
    """
    e = edges.where("edge_type = 'CALLS'").select(F.col("to_symbol").alias("symbol"), F.col("from_node").alias("chunk_id")).join(asked.select("symbol").distinct(), "symbol", "left_semi")
    first = _first_named(e.join(chunks.select("chunk_id", "repo_id"), "chunk_id"), k, scopes is not None)
    hit = asked.join(first.drop("ord"), "symbol").select("query_id", "chunk_id", "repo_id").distinct()
    return top(in_scope(hit, scopes), k, ["chunk_id"]).withColumn("score", F.lit(score)).withColumn("source", F.lit("graph"))


def callees(asked: DataFrame, edges: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, names: int = 10, k: int = 8, score: float = 0.5) -> DataFrame:
    """Definitions of what the definitions of asked (query_id, symbol) call.

    What a symbol calls, and the first definitions of a name, are found once each, however many queries ask for them.
    """
    own = chunks.select("symbol", F.col("chunk_id").alias("from_node")).join(asked.select("symbol").distinct(), "symbol", "left_semi").distinct()
    called = own.join(edges.where("edge_type = 'CALLS'").select("from_node", "to_symbol"), "from_node").select("symbol", "to_symbol").distinct()
    of_symbol = top(called, names, ["to_symbol"], "symbol").drop("ord")
    wanted = top(asked.join(of_symbol, "symbol").select("query_id", F.col("to_symbol").alias("symbol")).distinct(), names, ["symbol"]).drop("ord")
    first = _first_named(chunks.where(F.col("chunk_type").isin(DEFINITION_TYPES)), k, scopes is not None)
    hit = wanted.join(first.drop("ord"), "symbol").select("query_id", "chunk_id", "repo_id").distinct()
    return top(in_scope(hit, scopes), k, ["chunk_id"]).withColumn("score", F.lit(score)).withColumn("source", F.lit("graph"))


def graph_expand(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 10, names: int = 20, score: float = 0.3) -> DataFrame:
    """Definitions one call away from seeds (query_id, chunk_id, symbol), and of their own symbols; never a seed.

    Of a name, by repo under scopes, a query meets the first k definitions, and one more for each that is a seed of its own.
    """
    at_seeds = edges.where("edge_type = 'CALLS'").select(F.col("from_node").alias("chunk_id"), "to_symbol").join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    called = seeds.join(at_seeds, "chunk_id").select("query_id", F.col("to_symbol").alias("name"), F.lit(0).alias("own"))
    own = seeds.where("symbol is not null").select("query_id", F.col("symbol").alias("name"), F.lit(1).alias("own"))
    wanted = top(called.union(own).groupBy("query_id", "name").agg(F.min("own").alias("own")), names, ["own", "name"]).drop("ord", "own")
    defs = chunks.where(F.col("chunk_type").isin(DEFINITION_TYPES)).select(F.col("symbol").alias("name"), "chunk_id", "repo_id").distinct()
    seeded = seeds.select("query_id", "chunk_id").distinct().join(defs, "chunk_id").groupBy("query_id", "name").agg(F.count("*").cast("int").alias("seeded"))
    ranked = defs.withColumn("ord", F.row_number().over(W.partitionBy("name", *(["repo_id"] if scopes is not None else [])).orderBy("chunk_id")))
    places = F.sequence(F.lit(1), F.lit(k) + F.coalesce("seeded", F.lit(0)))
    met = wanted.join(seeded, ["query_id", "name"], "left").select("query_id", "name", F.explode(places).alias("ord")).join(ranked, ["name", "ord"])
    hit = met.select("query_id", "chunk_id", "repo_id").distinct().join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top(in_scope(hit, scopes), k, ["chunk_id"]).withColumn("score", F.lit(score)).withColumn("source", F.lit("graph"))


def _last_segment(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def read_file_chunks(asked: DataFrame, chunks: DataFrame, scopes: DataFrame | None = None, k: int = 12, score: float = 0.55) -> DataFrame:
    """Chunks of the path that ends as asked (query_id, path, start_line, end_line), over its lines, in order."""
    a = asked.select("query_id", F.col("path").alias("end"), F.coalesce("start_line", F.lit(1)).alias("from"), F.coalesce("end_line", F.lit(100_000)).alias("to")).withColumn("key", _last_segment(F.col("end")))
    hit = a.join(chunks.withColumn("key", _last_segment(F.col("path"))), "key").where(F.lower("path").endswith(F.lower("end")) & (F.col("start_line") <= F.col("to")) & (F.col("end_line") >= F.col("from")))
    return top(in_scope(hit, scopes), k, ["start_line", "chunk_id"]).select("query_id", "chunk_id", "repo_id", "ord", F.lit(score).alias("score"), F.lit("exact").alias("source"))


def best_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """For line hits (hit_id, repo_id, path, start_line, end_line, snippet) the chunk over them: with a symbol first, then the shortest.

    A hit without one becomes a chunk of its own, of its snippet.
    """
    h = hits.withColumn("key", _last_segment(F.col("path"))).alias("h")
    c = chunks.withColumn("key", _last_segment(F.col("path"))).alias("c")
    fits = h.join(c, (F.col("h.repo_id") == F.col("c.repo_id")) & (F.col("h.key") == F.col("c.key")) & F.lower("c.path").endswith(F.lower("h.path")) & overlap("h", "c"))
    order = W.partitionBy("hit_id").orderBy(F.col("c.symbol").isNull(), F.col("c.end_line") - F.col("c.start_line"), "c.chunk_id")
    first = fits.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("hit_id", F.col("c.chunk_id").alias("chunk_id"), F.col("c.content").alias("found"))
    from ..functions.ids import stable_id

    own = stable_id(F.col("repo_id"), F.col("path"), F.lit("snippet"), F.col("start_line"), F.col("end_line"))
    return hits.join(first, "hit_id", "left").withColumn("synthetic", F.col("chunk_id").isNull()).withColumn("content", F.coalesce("found", "snippet")).withColumn("chunk_id", F.coalesce("chunk_id", own)).drop("found")


def resolve_names(edges: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """CALLS edges with the symbols they may mean: at most the first few of a repo's name, ranked before the join."""
    ranked = symbols.withColumn("rn", F.row_number().over(W.partitionBy("repo_id", "display_name").orderBy("symbol_id"))).where(F.col("rn") <= most)
    return edges.where("edge_type = 'CALLS'").join(ranked.select("repo_id", F.col("display_name").alias("to_symbol"), "symbol_id"), ["repo_id", "to_symbol"])


def build_symbol_facts(chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references) from definitions and the calls between them."""
    from ..functions.ids import stable_id

    kinds = F.create_map(*[F.lit(x) for p in {"function": "function", "method": "method", "class": "class", "struct": "struct", "type": "type", "interface": "interface"}.items() for x in p])
    symbols = chunks.where("symbol is not null").where(F.col("chunk_type").isin(DEFINITION_TYPES)).select(
        stable_id(*[F.col(c) for c in ("repo_id", "path", "symbol", "start_line")]).alias("symbol_id"), "repo_id", F.col("symbol"), F.col("symbol").alias("display_name"), F.coalesce(F.try_element_at(kinds, F.col("chunk_type")), F.lit("unknown")).alias("kind"), "path", "start_line", "end_line", F.col("chunk_id").alias("definition_chunk_id")
    )
    at = resolve_names(edges, symbols).join(chunks.select(F.col("chunk_id").alias("from_node"), F.col("repo_id").alias("r_"), "path", "start_line", "end_line", F.col("symbol").alias("enclosing_symbol")), "from_node")
    references = at.select(stable_id(F.col("symbol_id"), F.col("from_node"), F.col("line")).alias("reference_id"), "repo_id", "symbol_id", F.lit("reference").alias("role"), "path", F.coalesce("line", "start_line").alias("start_line"), F.coalesce("line", "end_line").alias("end_line"), "enclosing_symbol")
    return symbols, references.dropDuplicates(["reference_id"])


def substring_search(queries: DataFrame, chunks: DataFrame, grams: DataFrame | None = None, scopes: DataFrame | None = None, k: int = 25, most: int = 10) -> DataFrame:
    """Best k chunks whose symbol, path or content holds one of a query's first needles, upper and lower case alike.

    queries: query_id, needles, symbols; grams: as build_grams() gives, where they are kept for many searches.
    Chunks with a symbol that the query names come first, then those of the smallest id. An empty needle is in
    every chunk and is left out.
    """
    asked = queries.select("query_id", "symbols", F.explode(F.slice("needles", 1, most)).alias("literal")).withColumn("literal", F.lower("literal")).where("literal <> ''")
    asked = shared(stored(asked, "asked"))
    if grams is None:
        found = _inside_texts(asked, chunks.select("chunk_id", "repo_id", "symbol", _all_text().alias("text")).repartition("chunk_id"))
    else:
        found = _holding(asked, grams, chunks.select("chunk_id", "repo_id", _all_text().alias("text"))).join(chunks.select("chunk_id", "symbol"), "chunk_id")
    hit = found.join(asked, "literal").groupBy("query_id", "chunk_id", "repo_id").agg(F.max(F.coalesce(F.array_contains("symbols", F.col("symbol")), F.lit(False)).cast("int")).alias("named"))
    best = top(in_scope(hit, scopes), k, [F.desc("named"), "chunk_id"])
    return best.select("query_id", "chunk_id", "repo_id", "ord", (F.lit(0.4) + 0.4 * F.col("named")).alias("score"), F.lit("lexical").alias("source"))


def vector_rows(chunks: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """What is stored beside a chunk's vector: its place and symbol, empty strings for nulls; repos (repo_id, full_name) names repos."""
    named = chunks.join(repos.select("repo_id", F.col("full_name").alias("repo_full_name")), "repo_id", "left") if repos is not None else chunks.withColumn("repo_full_name", F.col("repo_id"))
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("language", "symbol", "commit_sha")]
    return named.select("chunk_id", "repo_id", F.coalesce("repo_full_name", "repo_id").alias("repo_full_name"), "path", "chunk_type", "start_line", "end_line", *texts)
