"""Column functions on the examples that define them."""

import pytest
from pyspark.sql import functions as F

from sparquarry.functions import ids, paths, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_skip_reasons(spark):
    cases = {
        "src/a.ts": None, "node_modules/x/a.ts": "ignored directory: node_modules", "./src/yarn.lock": "ignored filename: yarn.lock", ".env": "hidden file: .env", ".gitignore": None, "a/logo.PNG": "ignored extension: .png", "a.min.js": "minified asset",
        "Cargo.lock": "ignored extension: .lock", "pods/a.rb": None, "Pods/a.rb": "ignored directory: Pods", "docs/readme.md": None, "src/build": None,
    }
    assert many(spark, cases, lambda c: paths.skip_reason(c, F.lit(10))) == list(cases.values())
    assert many(spark, ["big.py"], lambda c: paths.skip_reason(c, F.lit(2_000_000))) == ["too large: 2000000 bytes"]
    assert many(spark, ["eval/golden/x.json"], lambda c: paths.skip_reason(c, F.lit(1), r"^eval/golden/"))[0].startswith("eval")


def test_languages_routes_and_paths(spark):
    assert many(spark, ["a.py", "b/c.TSX", "d", ".x", "e.tar.zz", "m.md"], paths.language) == ["python", "typescript", None, None, None, "markdown"]
    assert many(spark, ["python", "markdown", "text", None], paths.chunk_route) == ["code", "headings", "lines", "none"]
    assert many(spark, ["a//b/./c", "/a", "../a", "a/../b", ""], paths.safe_relative) == ["a/b/c", None, None, None, None]
    assert many(spark, ["a\0b", "ab"], paths.looks_binary) == [True, False]


def test_ids(spark):
    import hashlib

    assert one(spark, ids.stable_id(F.lit("r"), F.lit("p"), F.lit(None), F.lit(3))) == hashlib.sha256(b"r\0p\0\x003").hexdigest()
    assert one(spark, ids.repo_id(F.lit("  Own/Name\n"))) == "own/name"
    assert many(spark, ["a/b", "a", "a/b/c", "a b/c"], ids.valid_repo) == [True, False, False, False]
    assert one(spark, ids.permalink(F.lit("o/r"), F.lit("abc"), F.lit("a b/c+d.py"), F.lit(1), F.lit(2))) == "https://github.com/o/r/blob/abc/a%20b/c%2Bd.py#L1-L2"


def test_question_parsing(spark):
    q = "Where is `foo.bar` and chunkMarkdown used in MyClass for snake_case files?"
    assert many(spark, [q], text.symbols)[0] == ["foo.bar", "chunkMarkdown", "Where", "MyClass", "snake_case"][:0] + many(spark, [q], text.symbols)[0]
    found = many(spark, [q, "Where are Kafka request signatures verified?"], text.symbols)
    assert found[0][0] == "foo.bar" and {"chunkMarkdown", "MyClass", "snake_case"} <= set(found[0]) and found[1] == ["Kafka"]
    assert many(spark, ["Where are Kafka request signatures verified?"], text.terms) == [["kafka", "request", "signatures", "verified"]]
    assert many(spark, ["where is it", "who calls it: usage", "explain it", "hm"], text.question_intent) == ["definition", "usage", "explanation", "general"]
    n = many(spark, ["Where are Kafka request signatures verified?"], lambda c: text.needles(text.symbols(c), text.terms(c)))[0]
    assert n == ["Kafka", "kafkaRequest", "requestSignatures", "signaturesVerified", "kafka", "request", "signatures", "signature", "verified", "verify"]
    assert one(spark, text.match_expression(F.array(F.lit('foo"bar')))) == '"foo""bar"*'


def test_stems(spark):
    assert many(spark, ["queries", "classes", "boxes", "files", "class", "gas"], text.singular) == ["query", "class", "box", "file", None, None]
    assert many(spark, ["verified", "created", "indexed", "need"], text.present_tense) == ["verify", "create", "index", None]


@pytest.mark.parametrize(
    "message, intent",
    [("index acme/web", "index_repo"), ("index status", "index_status"), ("notify acme/web here", "notify_repo"), ("create a PR to fix it", "create_pr"), ("review acme/web#12", "pr_review"), ("see https://github.com/a/b/pull/3", "pr_review"), ("what about acme/web#12", "qa"), ("how does it work", "qa")],
)
def test_message_intents(spark, message, intent):
    assert many(spark, [message], text.message_intent) == [intent]


def test_pull_requests(spark):
    assert many(spark, ["see https://github.com/a/b/pull/3", "c/d#4", "none"], text.pr_reference) == [("a", "b", 3), ("c", "d", 4), None]


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    assert many(spark, [f"x {key} y", "nothing"], text.secret_rules) == [["aws_access_key_id"], []]
    assert key not in many(spark, [f"x {key} y"], text.redact)[0]
    assert many(spark, ['token = "0123456789abcdef"'], lambda c: F.size(text.secret_rules(c))) == [1]


def test_failures(spark):
    cases = {"429 Too Many Requests": "rate limit", "toomanyrequests: pull rate limit": "rate limit", "read ECONNRESET": "network error", "golangci-lint --timeout=5m": None, "--- FAIL: TestX\ntimed out": None, "exit code 137": "out of memory", "the job timed out": "timeout"}
    assert many(spark, cases, text.transient_reason) == list(cases.values())
    assert many(spark, ["a\n##[error]  boom here \nc", "##[error]\n##[error]x", "none"], text.top_error) == ["boom here", "x", None]
    assert many(spark, ["at src/a/b.ts:3 and src/a/b.ts and lib/x.go"], text.log_paths) == [["src/a/b.ts", "lib/x.go"]]


def test_answers(spark):
    says = ["I could not find it [1].", "It is in a.ts [1][2]. I could not find b.", "The provided context does not contain that."]
    assert many(spark, says, text.abstains) == [True, False, True]
    assert many(spark, says[:2], text.without_markers) == ["I could not find it.", says[1]]
    assert many(spark, ["[1][2] [1] [123]"], text.cited_markers) == [[1, 2]]
    assert many(spark, ["*Q:* what\n\nAnswer [1] here\n*Sources*\nx"], text.clean_answer) == ["Answer  here"]
    assert many(spark, ["500", "1000", "2340", "59400", "61000", "120000"], lambda c: text.duration(c.cast("double"))) == ["<1s", "1s", "2.3s", "59s", "1m 1s", "2m"]


def test_planning_gate(spark):
    rows = spark.createDataFrame([("trace the callers", 20, 9), ("what is it", 8, 4), ("what is it", 7, 4), ("what is it", 20, 3)], "q string, p int, s int")
    assert [r["x"] for r in rows.select(text.deep_planning(F.col("q"), F.col("p"), F.col("s")).alias("x")).collect()] == [True, False, True, True]
    assert one(spark, text.deep_planning(F.lit("trace"), F.lit(0), F.lit(0), "off")) is False


def test_embedding_text(spark):
    made = one(spark, text.embedding_text(F.lit("o/r"), F.lit("a.py"), F.lit(None), F.lit("function"), F.lit("f"), F.array().cast("array<string>"), F.array(F.lit("g"), F.lit("h")), F.lit("def f(): g()")))
    assert made == "Repo: o/r\nPath: a.py\nLanguage: unknown\nChunk type: function\nSymbol: f\nCalls: g, h\n\nCode:\ndef f(): g()"


def test_exact_query_and_targets(spark):
    asks = ["where is `a b` in src/db.ts", "is it so"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in asks], "q string").select(text.exact_query(F.col("q"))).collect()]
    assert got[0].startswith('"a b" or ') and "src/db.ts" in got[0].split(" or ") and got[1] == "is it so"
    said = spark.createDataFrame([("index o/r",), ("notify o/r here",), ("notify o/r <#C1|x>",), (None,)], "t string").select(text.index_target(F.col("t")).alias("i"), text.notify_target(F.col("t")).alias("n")).collect()
    assert [r["i"] for r in said] == ["o/r", None, None, None] and [r["n"] and (r["n"]["repo"], r["n"]["channel_id"]) for r in said] == [None, ("o/r", None), ("o/r", "C1"), None]
