"""Named queries and SQL of code definitions, question and message columns, scopes by mention and grant streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, text
from ..operators import chunking, evaluate, scope
from ..streaming import jobs
from .fixtures import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def quoted(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _code(spark, d):
    """A source file for each document: a class with one to four methods, in one of three languages."""
    doc, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    each = lambda a, b, c: F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: F.concat(F.lit(a), i.cast("string"), F.lit(b), i.cast("string"), F.lit(c))), "")
    java = F.concat(F.lit("package p;\n\nimport a.b"), doc, F.lit(";\n\npublic class C"), doc, F.lit(" {\n"), each("  public int m", "(int x) {\n    return call", "(x.size());\n  }\n"), F.lit("}\n"))
    go = F.concat(F.lit('package p\n\nimport "a.b'), doc, F.lit('"\n\ntype C'), doc, F.lit(" struct {\n"), F.lit("\tn int\n}\n"), each("func (c *C) m", "(x int) int {\n\treturn call", "(x.size())\n}\n"))
    ts = F.concat(F.lit("import x from 'a.b"), doc, F.lit("';\n\nexport class C"), doc, F.lit(" {\n"), each("  m", "(x: T): T {\n    return call", "(x.size());\n  }\n"), F.lit("}\n"))
    lang = F.when(k == 0, "java").when(k == 1, "go").otherwise("typescript")
    return read(spark, d, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("src/"), doc).alias("path"), lang.alias("language"), F.when(k == 0, java).when(k == 1, go).otherwise(ts).alias("content"))


_CODE = """WITH f AS (SELECT 'src/' || doc_id AS path, 'C' || doc_id AS cls, 'a.b' || doc_id AS module, doc_id % 3 AS k, doc_id % 4 + 1 AS m, CASE doc_id % 3 WHEN 2 THEN 3 ELSE 5 END AS first_ FROM documents),
methods AS (SELECT path, 'm' || i AS symbol, first_ + (CASE k WHEN 1 THEN 3 ELSE 1 END) + 3 * i AS start_line, i FROM (SELECT *, unnest(range(0, m)) AS i FROM f))
"""


@query(_CODE + "SELECT path, 'import' AS chunk_type, NULL AS symbol, first_ - 2 AS start_line, first_ - 2 AS end_line FROM f UNION ALL SELECT path, CASE k WHEN 1 THEN 'struct' ELSE 'class' END, cls, first_, first_ + (CASE k WHEN 1 THEN 2 ELSE 3 * m + 1 END) FROM f UNION ALL SELECT path, 'method', symbol, start_line, start_line + 2 FROM methods")
def x3_code_definitions(spark, d):
    return chunking.chunk_definitions(_code(spark, d))[0].select("path", "chunk_type", "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(_CODE + "SELECT path, NULL AS from_symbol, 'IMPORTS' AS edge_type, module AS to_symbol FROM f UNION ALL SELECT path, symbol, 'CALLS', unnest(['call' || i, 'size']) FROM methods")
def a9_code_edges(spark, d):
    chunks, edges = chunking.chunk_definitions(_code(spark, d))
    return edges.join(chunks.select(F.col("chunk_id").alias("from_node"), "path", F.col("symbol").alias("from_symbol")), "from_node").select("path", "from_symbol", "edge_type", "to_symbol")


def _nested_code(spark, d):
    """A source file for each document whose braces in texts and comments, indents and long signatures mislead: a class, then one to four methods."""
    doc, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    each = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: F.concat(F.lit(a), i.cast("string"), F.lit(b), i.cast("string"), F.lit("(x);\n      }\n"))), "")
    java = F.concat(F.lit("public class C"), doc, F.lit("\n{\n  /* class Ghost { */\n"), each("  public Map<A, B> m", "(\n      A x,\n      B y) throws E\n  {\n    // }\nString s = \"}} \\\" {\";\n    if (x) { a(s); } else {\n}\n    return call"), F.lit("}\n"))
    go = F.concat(F.lit("type C"), doc, F.lit(" struct {\n\tn int\n}\n/* func Ghost() { */\n"), each("func (c *C) m", "(\n\tx A,\n\ty B,\n) error {\n\ts := `\n}`\n\tif x { a(s) } else {\n}\n\treturn call"))
    ts = F.concat(F.lit("export class C"), doc, F.lit("\n  extends B {\n  /* class Ghost { */\n"), each("  async m", "(\n    { x }: { x: A },\n    y = 1,\n  ): Promise<B> {\n    const s = `\n}`;\n    if (x) { a(s); } else {\n}\n    return call"), F.lit("}\n"))
    lang = F.when(k == 0, "java").when(k == 1, "go").otherwise("typescript")
    return read(spark, d, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("src/"), doc).alias("path"), lang.alias("language"), F.when(k == 0, java).when(k == 1, go).otherwise(ts).alias("content"))


_NESTED = """WITH f AS (SELECT 'src/' || doc_id AS path, 'C' || doc_id AS cls, doc_id % 3 AS k, doc_id % 4 + 1 AS m, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 4 END AS first_ FROM documents),
methods AS (SELECT path, 'm' || i AS symbol, first_ + 10 * i AS start_line, i FROM (SELECT *, unnest(range(0, m)) AS i FROM f))
"""


@query(_NESTED + "SELECT path, CASE k WHEN 1 THEN 'struct' ELSE 'class' END AS chunk_type, cls AS symbol, 1 AS start_line, CASE k WHEN 1 THEN 3 ELSE 10 * m + first_ END AS end_line, [] AS calls FROM f UNION ALL SELECT path, 'method', symbol, start_line, start_line + 9, ['a', 'call' || i] FROM methods")
def x3_nested_bodies(spark, d):
    return chunking.code_definitions(_nested_code(spark, d)).select("path", "chunk_type", "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.array_sort("calls").alias("calls"))


@query("""WITH r AS (SELECT o_orderpriority AS dataset, strftime(o_orderdate, '%Y-%m') AS run_id, (o_custkey % 129) / CAST(128 AS DOUBLE) AS composite, CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey % 17) / CAST(16 AS DOUBLE) END AS citation_f1, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 4) / CAST(4 AS DOUBLE) END AS source_recall, o_orderkey % 7 = 0 AS negative, o_orderkey % 13 = 0 AS failed, o_custkey % 500 AS ms FROM orders),
s AS (SELECT dataset, run_id, count(*) AS cases, round(avg(composite), 4) AS mean_composite, avg(citation_f1) AS f1, avg(source_recall) AS recall, avg(composite) AS raw, avg(composite) FILTER (negative AND NOT failed) AS declined, count(*) FILTER (failed) AS failures, CAST(sum(ms) AS BIGINT) AS total_ms FROM r GROUP BY ALL),
b AS (SELECT dataset, arg_min(mean_composite, run_id) AS base FROM s WHERE dataset NOT LIKE '5%' GROUP BY dataset),
h AS (SELECT *, round(mean_composite - lag(mean_composite) OVER (PARTITION BY dataset ORDER BY run_id), 4) AS delta_previous, round(mean_composite - base, 4) AS delta_baseline FROM s LEFT JOIN b USING (dataset))
SELECT dataset, run_id, cases, mean_composite, round(f1, 4) AS mean_citation_f1, round(recall, 4) AS mean_source_recall, round(declined, 4) AS abstain_accuracy, failures, total_ms, delta_previous, delta_baseline, CASE WHEN delta_baseline > 0 THEN 'improved' WHEN delta_baseline < 0 THEN 'regressed' WHEN delta_baseline = 0 THEN 'unchanged' END AS trend, raw >= 0.5 AS passed FROM h""")
def s17_run_history(spark, d):
    """A run for each month of orders and a dataset for each priority; the first run of a dataset is pinned, but for one without. Sums of the scores are exact in any order."""
    o, key = read(spark, d, "orders"), F.col("o_custkey")
    results = o.select(
        F.col("o_orderpriority").alias("dataset"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.date_trunc("month", "o_orderdate").alias("ran_at"), (key % 129 / 128).alias("composite"), F.when(key % 3 > 0, F.col("o_orderkey") % 17 / 16).alias("citation_f1"),
        F.when(key % 5 > 0, key % 4 / 4).alias("source_recall"), (F.col("o_orderkey") % 7 == 0).alias("negative"), F.when(F.col("o_orderkey") % 13 == 0, "timeout").alias("error"), (key % 500).alias("total_ms"),
    )
    runs = evaluate.run_summaries(results)
    first = runs.where("dataset not like '5%'").groupBy("dataset").agg(F.min("run_id").alias("run_id"))
    means = [F.round(c, 4).alias(c) for c in ("mean_composite", "mean_citation_f1", "mean_source_recall", "abstain_accuracy")]
    return evaluate.run_history(runs, first, fail_under=0.5).select("dataset", "run_id", "cases", *means, "failures", "total_ms", "delta_previous", "delta_baseline", "trend", "passed")


_SAID = ["notify o/r here", "index status", "index the repo o/r", "please open a pull request", "review o/r#12", "see https://github.com/o/r/pull/7", "how are o/r#3 and this called"]


def _said(spark, d):
    said = F.get(F.array(*[F.lit(s) for s in _SAID]), (F.col("c_custkey") % 8).cast("int"))
    return read(spark, d, "customer").select("c_custkey", F.coalesce(said, F.col("c_name")).alias("m"))


_SAID_SQL = f"WITH s AS (SELECT c_custkey, coalesce(({_SAID})[1 + c_custkey % 8], c_name) AS m FROM customer)"
_PR = f"CASE WHEN regexp_matches(m, {quoted(text.PR_URL)}) THEN regexp_extract(m, {quoted(text.PR_URL)}, %d) WHEN regexp_matches(m, {quoted(text.PR_SHORT)}) THEN regexp_extract(m, {quoted(text.PR_SHORT)}, %d) END"


@query(
    _SAID_SQL
    + f""" SELECT c_custkey, CASE WHEN regexp_matches(m, {quoted(text.NOTIFY)}) THEN 'notify_repo' WHEN regexp_matches(m, {quoted(text.INDEX_STATUS)}) THEN 'index_status' WHEN regexp_matches(m, {quoted(text.INDEX_REPO)}) THEN 'index_repo' WHEN regexp_matches(m, {quoted(text.CREATE_PR)}) OR regexp_matches(m, {quoted(text.CREATE_PR_LINE)}) THEN 'create_pr'
 WHEN regexp_matches(m, {quoted(text.PR_URL)}) OR (regexp_matches(m, {quoted(text.PR_SHORT)}) AND regexp_matches(m, {quoted(text.REVIEW_VERB)})) THEN 'pr_review' ELSE 'qa' END AS intent, {_PR % (2, 2)} AS repo, CAST({_PR % (3, 3)} AS BIGINT) AS number FROM s"""
)
def p15_message_intents(spark, d):
    pr = text.pr_reference(F.col("m"))
    return _said(spark, d).select("c_custkey", text.message_intent(F.col("m")).alias("intent"), pr["repo"].alias("repo"), pr["number"].alias("number"))


@query(f"SELECT doc_id, regexp_matches(text, {quoted(text.DEEP_TRACE)}) OR NOT (n_chars % 12 >= 8 AND n_chars % 7 >= 4) AS deep FROM documents")
def p16_deep_planning(spark, d):
    return read(spark, d, "documents").select("doc_id", text.deep_planning(F.col("text"), F.col("n_chars") % 12, F.col("n_chars") % 7).alias("deep"))


_REPO = "CASE doc_id % 4 WHEN 0 THEN source || '/' || lang WHEN 1 THEN ' Own/' || lang || chr(10) WHEN 2 THEN source ELSE source || '/a b' END"


@query(f"WITH r AS (SELECT doc_id, {_REPO} AS r, text FROM documents) SELECT doc_id, regexp_full_match(r, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS valid, lower(trim(r, ' ' || chr(10))) AS repo_id, greatest(1, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT)) AS short_number FROM r")
def p17_repo_names(spark, d):
    k, src = F.col("doc_id") % 4, F.col("source")
    r = F.when(k == 0, F.concat(src, F.lit("/"), "lang")).when(k == 1, F.concat(F.lit(" Own/"), "lang", F.lit("\n"))).when(k == 2, src).otherwise(F.concat(src, F.lit("/a b")))
    return read(spark, d, "documents").select("doc_id", ids.valid_repo(r).alias("valid"), ids.repo_id(r).alias("repo_id"), ids.short_number(F.coalesce("text", F.lit(""))).alias("short_number"))


_SINGULAR = "CASE WHEN length(w) <= 3 THEN NULL WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%ses' AND length(w) > 4 THEN w[:-3] WHEN regexp_matches(w, '(ches|shes|xes|zes)$') THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] END"
_STEM = "CASE WHEN length(w) <= 4 OR w NOT LIKE '%ed' THEN NULL WHEN w LIKE '%ied' THEN w[:-4] || 'y' WHEN w LIKE '%ated' THEN w[:-2] ELSE w[:-3] END"


@query(f"SELECT DISTINCT w, {_SINGULAR} AS singular, {_STEM} AS stem, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS compact FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def f7_f10_word_forms(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return words.select("w", text.singular(F.col("w")).alias("singular"), text.present_tense(F.col("w")).alias("stem"), text.compact(F.col("w")).alias("compact"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) > 1) AS l FROM documents), n AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS l FROM t)
SELECT doc_id, array_to_string(list_transform(l, lambda x: '"' || replace(x, '"', '""') || '"*'), ' OR ') AS expression FROM n""")
def f8_match_expressions(spark, d):
    found = F.slice(F.array_distinct(F.filter(F.split("text", " "), lambda x: F.length(x) > 1)), 1, 10)
    return read(spark, d, "documents").select("doc_id", text.match_expression(found).alias("expression"))


_LOG = "'a/b' || doc_id || '.ts then ' || lang || '/x-1.py' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '##[error]  ' || source || ' fails  ' || chr(10) ELSE '' END || 'see [' || doc_id % 15 || '] [' || doc_id % 4 || '] [123] c/d.yml a/b' || doc_id || '.ts'"


@query(rf"WITH l AS (SELECT doc_id, {_LOG} AS x FROM documents), m AS (SELECT *, regexp_extract_all(x, {quoted(text.PATHS)}) AS p, regexp_extract_all(x, '\[(\d{{1,2}})\]', 1) AS c FROM l) SELECT doc_id, nullif(trim(regexp_extract(x, '##\[error\]([^\n]*)', 1)), '') AS top_error, array_to_string(list_filter(p, lambda v, i: list_position(p, v) = i)[1:8], ' ') AS paths, array_to_string(list_filter(c, lambda v, i: list_position(c, v) = i), ' ') AS markers FROM m")
def f14_f17_log_columns(spark, d):
    doc = F.col("doc_id")
    x = F.concat(F.lit("a/b"), doc, F.lit(".ts then "), "lang", F.lit("/x-1.py\n"), F.when(doc % 3 == 0, F.concat(F.lit("##[error]  "), "source", F.lit(" fails  \n"))).otherwise(F.lit("")), F.lit("see ["), doc % 15, F.lit("] ["), doc % 4, F.lit("] [123] c/d.yml a/b"), doc, F.lit(".ts"))
    rows = read(spark, d, "documents").select("doc_id", x.alias("x"))
    return rows.select("doc_id", text.top_error(F.col("x")).alias("top_error"), F.array_join(text.log_paths(F.col("x")), " ").alias("paths"), F.array_join(text.cited_markers(F.col("x")), " ").alias("markers"))


@query("WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey ELSE o_orderkey * 37 END AS ms FROM orders), s AS (SELECT *, ms / 1000.0 AS s, floor(ms / 60000.0) AS m, floor(ms / 1000.0 - 60 * floor(ms / 60000.0) + 0.5) AS r FROM t), k AS (SELECT *, CAST(m + CASE WHEN r = 60 THEN 1 ELSE 0 END AS BIGINT) AS mm, CAST(CASE WHEN r = 60 THEN 0 ELSE r END AS BIGINT) AS rr FROM s) SELECT o_orderkey, CASE WHEN s < 1 THEN '<1s' WHEN s < 10 THEN regexp_replace(printf('%.1f', floor(s * 10 + 0.5) / 10), '\\.0$', '') || 's' WHEN s < 60 THEN CAST(floor(s + 0.5) AS BIGINT) || 's' ELSE mm || 'm' || CASE WHEN rr > 0 THEN ' ' || rr || 's' ELSE '' END END AS took FROM k".replace("\\\\", "\\"))
def f21_durations(spark, d):
    ms = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_orderkey") * 37)
    return read(spark, d, "orders").select("o_orderkey", text.duration(ms).alias("took"))


@query("WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || page_id WHEN 1 THEN 'a//./b/' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN './' ELSE url END AS p, CASE WHEN page_id % 2 = 0 THEN repeat('x', 100 * (page_id % 100)) || chr(0) ELSE url END AS c FROM pages), s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS l FROM p) SELECT page_id, CASE WHEN p LIKE '/%' OR list_contains(l, '..') OR len(l) = 0 THEN NULL ELSE array_to_string(l, '/') END AS safe, page_id % 2 = 0 AND 100 * (page_id % 100) < 8000 AS binary_ FROM s")
def p2_f25_paths(spark, d):
    k, page = F.col("page_id") % 5, F.col("page_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("/"), page)).when(k == 1, F.concat(F.lit("a//./b/"), page)).when(k == 2, F.concat(F.lit("a/../"), page)).when(k == 3, "./").otherwise(F.col("url"))
    c = F.when(F.col("page_id") % 2 == 0, F.concat(F.repeat(F.lit("x"), (100 * (F.col("page_id") % 100)).cast("int")), F.lit("\0"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", paths.safe_relative(p).alias("safe"), paths.looks_binary(c).alias("binary_"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'headings' WHEN 'fr' THEN 'none' ELSE 'lines' END AS route FROM documents")
def p4_chunk_routes(spark, d):
    lang = F.when(F.col("lang") == "en", "go").when(F.col("lang") == "de", "markdown").when(F.col("lang") == "fr", F.lit(None)).otherwise("yaml")
    return read(spark, d, "documents").select("doc_id", paths.chunk_route(lang).alias("route"))


@query("WITH q AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 30 END AS tenant_id FROM orders) SELECT query_id, s_suppkey AS repo_id FROM q JOIN nation ON n_nationkey = tenant_id AND n_regionkey <> 1 JOIN supplier ON s_nationkey = tenant_id AND s_acctbal > 0 UNION SELECT query_id, p_partkey FROM q JOIN part ON tenant_id IS NULL AND p_size = 7 AND p_partkey % 20 = 0")
def j2_tenant_scope(spark, d):
    q = read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 30).alias("tenant_id"))
    tenants = read(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), (F.col("n_regionkey") != 1).alias("active"))
    chosen = read(spark, d, "supplier").select(F.col("s_nationkey").alias("tenant_id"), F.col("s_suppkey").alias("repo_id"), (F.col("s_acctbal") > 0).alias("enabled"))
    legacy = read(spark, d, "part").select(F.col("p_partkey").alias("repo_id"), ((F.col("p_size") == 7) & (F.col("p_partkey") % 20 == 0)).alias("enabled"))
    return scope.tenant_scope(q, tenants, chosen, legacy)


def _mentions(spark, d):
    """Questions of documents' last words on repos named by order priorities and ship modes."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("where does "), F.get(F.array(*[F.lit(x) for x in _ASKED]), (F.col("c_custkey") % 6).cast("int")), F.lit(" start "), F.col("c_mktsegment")).alias("question"))
    return q, q.select("query_id", F.explode(names).alias("repo_id"))


_NAMES = ["own/web-shop", "own/web-api", "own/billing", "own/ab"]
_ASKED = ["own/billing", "the web-api", "web shop", "billings", "webhook", "nothing"]
#: Scores of each question for each name, worked out by hand from the rules.
_MENTIONS = "WITH q AS (SELECT c_custkey AS query_id, c_custkey % 6 AS k FROM customer), s AS (SELECT * FROM (VALUES (0, 'own/web-shop', 0), (0, 'own/web-api', 0), (0, 'own/billing', 100), (0, 'own/ab', 0), (1, 'own/web-shop', 3), (1, 'own/web-api', 80), (1, 'own/billing', 0), (1, 'own/ab', 0), (2, 'own/web-shop', 70), (2, 'own/web-api', 3), (2, 'own/billing', 0), (2, 'own/ab', 0), (3, 'own/web-shop', 0), (3, 'own/web-api', 0), (3, 'own/billing', 3), (3, 'own/ab', 0), (4, 'own/web-shop', 3), (4, 'own/web-api', 3), (4, 'own/billing', 0), (4, 'own/ab', 0), (5, 'own/web-shop', 0), (5, 'own/web-api', 0), (5, 'own/billing', 0), (5, 'own/ab', 0)) v(k, repo_id, score)), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM q JOIN s USING (k))"


@query(_MENTIONS + " SELECT query_id, repo_id FROM m WHERE best < 3 OR score = best")
def j22_mentioned_scope(spark, d):
    return scope.mentioned_scope(*_mentions(spark, d))


@query(_MENTIONS.split(", m AS")[0] + ", b AS (SELECT query_id, repo_id, CASE WHEN score = 100 OR (k = 3 AND score = 3) THEN 13 WHEN score = 80 THEN 16 WHEN score = 70 THEN 16 ELSE score END AS score FROM q JOIN s USING (k)) SELECT query_id, repo_id AS full_name, CAST(score AS INT) AS score FROM b WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo_id) = 1")
def j23_best_repo(spark, d):
    q, repos = _mentions(spark, d)
    return scope.best_repo(q, repos.withColumnRenamed("repo_id", "full_name")).select("query_id", "full_name", "score")


@query("""WITH c AS (SELECT o_custkey % 10 AS installation_id, o_orderkey % 97 AS repo_id, CASE WHEN o_orderkey % 11 = 0 THEN 'revoke' ELSE 'grant' END AS change, o_orderkey AS ord FROM orders), i AS (SELECT n_nationkey AS tenant_id, n_nationkey % 10 AS installation_id FROM nation),
sel AS (SELECT DISTINCT c_nationkey AS tenant_id, c_custkey % 97 AS repo_id FROM customer WHERE c_acctbal > 0), off AS (SELECT tenant_id, repo_id, min(ord) AS off_at FROM c JOIN i USING (installation_id) WHERE change = 'revoke' GROUP BY ALL), on_ AS (SELECT * FROM sel ANTI JOIN off USING (tenant_id, repo_id))
SELECT 'grant' AS what, installation_id AS who, repo_id FROM c GROUP BY installation_id, repo_id HAVING arg_max(change, ord) = 'grant'
UNION ALL SELECT 'grant', s_nationkey % 12, s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM c WHERE installation_id = s_nationkey % 12 AND repo_id = s_suppkey)
UNION ALL SELECT 'on', tenant_id, repo_id FROM on_
UNION ALL SELECT DISTINCT 'job', tenant_id, repo_id FROM c JOIN i USING (installation_id) JOIN sel USING (tenant_id, repo_id) LEFT JOIN off USING (tenant_id, repo_id) WHERE change = 'grant' AND (off_at IS NULL OR ord < off_at)
UNION ALL SELECT DISTINCT 'unused', NULL, repo_id FROM c WHERE change = 'revoke' AND repo_id NOT IN (SELECT repo_id FROM on_)""")
def st2_grant_changes(spark, d):
    """Orders as grants and revocations; the allow list holds revoked repos only, so that it ends empty."""
    order = F.col("o_orderkey")
    changes = read(spark, d, "orders").select((F.col("o_custkey") % 10).alias("installation_id"), (order % 97).alias("repo_id"), F.when(order % 11 == 0, "revoke").otherwise("grant").alias("change"), order.alias("ord"))
    installations = read(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), (F.col("n_nationkey") % 10).alias("installation_id"))
    chosen = read(spark, d, "customer").select(F.col("c_nationkey").alias("tenant_id"), (F.col("c_custkey") % 97).alias("repo_id"), (F.col("c_acctbal") > 0).alias("enabled")).distinct()
    grants = read(spark, d, "supplier").select((F.col("s_nationkey") % 12).alias("installation_id"), F.col("s_suppkey").alias("repo_id"))
    allowed = changes.where("change = 'revoke'").select("repo_id", F.lit(True).alias("enabled")).distinct()
    out = jobs.grant_changes(changes, grants, chosen, allowed, installations, ["ord"])
    of = lambda what, df, who: df.select(F.lit(what).alias("what"), who.cast("long").alias("who"), "repo_id")
    parts = of("grant", out["grants"], F.col("installation_id")).union(of("on", out["selections"].where("enabled"), F.col("tenant_id")))
    return parts.union(of("job", out["jobs"], F.col("tenant_id"))).union(of("unused", out["unused"], F.lit(None)))
