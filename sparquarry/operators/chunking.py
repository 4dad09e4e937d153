"""Files to chunks: line windows, heading sections, definitions. One row a file in, one a chunk out."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import callee_name, import_module, trim

MAX_CHARS = 8000
CHUNK = ["chunk_id", "repo_id", "path", "language", "chunk_type", "symbol", "start_line", "end_line", "content", "content_hash"]


def finished(df: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows with raw text to chunks: trimmed, blank ones left out, cut, with id and hash."""
    body = df.withColumn("content", F.substring(trim(F.col("raw")), 1, max_chars)).where("content <> ''")
    key = stable_id(*[F.col(c) for c in ("repo_id", "path", "chunk_type", "start_line", "end_line", "symbol")])
    return body.withColumn("chunk_id", key).withColumn("content_hash", F.sha2("content", 256)).select(*CHUNK)


def chunk_lines(files: DataFrame, window: int = 120, overlap: int = 10, max_chars: int = MAX_CHARS) -> DataFrame:
    """Overlapping windows of lines; the last one ends with the file. No shuffle."""
    step = window - overlap
    lined = files.withColumn("lines", F.split("content", "\n")).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - window) / step).cast("int")) * step, F.lit(step))
    each = lined.withColumn("at", F.explode(starts))
    raw = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(window)), "\n")
    return finished(each.select("repo_id", "path", "language", F.lit("generic").alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + window, F.col("n")).alias("end_line"), raw.alias("raw")), max_chars)


def _sections(lines: Column, is_start: Column) -> Column:
    """Line numbers (from 0) at which sections begin, the first line included."""
    return F.array_distinct(F.concat(F.array(F.lit(0)), is_start))


def chunk_headings(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Sections from one heading line to the next; what comes before the first has no symbol. No shuffle."""
    heading = r"^#{1,6}\s+(.*\S)\s*$"
    lined = files.withColumn("lines", F.split("content", "\n"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull())
    lined = lined.withColumn("starts", _sections(F.col("lines"), starts)).withColumn("n", F.size("lines"))
    each = lined.select("*", F.posexplode("starts").alias("k", "at")).withColumn("to", F.coalesce(F.get("starts", F.col("k") + 1), F.col("n")))
    title = F.regexp_extract(F.get("lines", F.col("at")), heading, 1)
    raw = F.array_join(F.slice("lines", F.col("at") + 1, F.col("to") - F.col("at")), "\n")
    return finished(each.select("repo_id", "path", "language", F.lit("section").alias("chunk_type"), F.when(title != "", title).alias("symbol"), (F.col("at") + 1).alias("start_line"), F.col("to").alias("end_line"), raw.alias("raw")), max_chars)


_JS_NAME = r"([A-Za-z_$][\w$]*)"
_JS = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*{_JS_NAME}", "function"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_JS_NAME}", "class"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{_JS_NAME}", "interface"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_JS_NAME}\s*(?:<.*>)?\s*=", "type"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_JS_NAME}", "type"),
    (rf"^\s++(?!(?:if|for|while|switch|catch|function|return|else|do|with|new|await)\b)(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*{_JS_NAME}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^;=]+)?\{{.*$", "method"),
]
_JAVA_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|default|native|strictfp)\s+)*"
_JAVA = [
    (rf"^\s*{_JAVA_MODIFIERS}class\s+([A-Za-z_]\w*)", "class"),
    (rf"^\s*{_JAVA_MODIFIERS}interface\s+([A-Za-z_]\w*)", "interface"),
    (rf"^\s*{_JAVA_MODIFIERS}(?:enum|record)\s+([A-Za-z_]\w*)", "type"),
    (rf"^\s+{_JAVA_MODIFIERS}(?:<[^(]+>\s*)?(?!(?:return|new|throw|else|case|assert)\b)[A-Za-z_][\w.]*(?:<[^(=]*>)?(?:\[\])*\s+(?!(?:if|for|while|switch|try)\b)([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?(?:\{{.*|;)?\s*$", "method"),
    (rf"^\s+{_JAVA_MODIFIERS}([A-Z]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{{.*$", "method"),
]
_GO = [
    (r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)", "method"),
    (r"^func\s+([A-Za-z_]\w*)", "function"),
    (r"^(?:type)?\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\s*\{", "struct"),
    (r"^(?:type)?\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\s*\{", "interface"),
    (r"^type\s+([A-Za-z_]\w*)", "type"),
]
#: Lines that begin a definition, by language: pattern with the name in its group, and kind. The first that fits holds.
DEFINITION_RULES = {"go": _GO, "java": _JAVA, "typescript": _JS, "javascript": _JS}
IMPORT_LINE = r"^\s*(import\b|from\s+\S+\s+import\b|const\s+.*=\s*require\()"
GO_IMPORT = r'^\s+(?:[\w.]+\s+)?["`][^"`\s]+["`]\s*$'
JS_IMPORT = r"(?m)^\s*import\b[^;'\"]*['\"][^'\"\n]+['\"]"
CALL = r"([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w., ]*>)?\("
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "function", "func", "synchronized", "try", "throw", "new", "typeof", "await", "assert", "select", "go", "defer", "case"]
_QUOTED = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
_JS_QUIET = rf"{_COMMENT}|(?<=(?:[(=,:\[!&|?{{}};]|\breturn)\s{{0,3}})/(?![/*])(?:[^/\\\n\[]|\\.|\[[^\]\n]*+\])++/|{_QUOTED}|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
#: Comments, texts and, in JavaScript, patterns: what they hold is no code.
QUIET = {"go": rf"{_COMMENT}|{_QUOTED}|`[^`]*+`", "java": rf'{_COMMENT}|"""[\s\S]*?"""|{_QUOTED}', "typescript": _JS_QUIET, "javascript": _JS_QUIET}
_JS_SURE, _JAVA_SURE = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b[^)]*\(", rf"^\s*(?:(?:public|private|protected|static)\b[^=;]*|{_JAVA_MODIFIERS}record\s[^=;]*)\("
_JS_MAYBE = rf"^\s++(?!(?:if|for|while|switch|catch|function|return|else|do|with|new|await)\b)(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*{_JS_NAME}\s*(?:<[^>]*>)?\("
_JAVA_MAYBE = rf"^\s+{_JAVA_MODIFIERS}(?!(?:return|new|throw|else|case|assert|if|for|while|switch|try|catch)\b)[A-Za-z_][\w.<>\[\], ?]*\("
#: Lines whose parameters may go on below: those that are signatures for sure, and those that may be calls.
SIGNATURES = {"go": (r"^func\b", r"^func\b"), "java": (_JAVA_SURE, _JAVA_MAYBE), "typescript": (_JS_SURE, _JS_MAYBE), "javascript": (_JS_SURE, _JS_MAYBE)}
_FOLDED = "struct<depth:int,parens:int,sig:string,sig_at:int,sig_base:int,sig_parens:int,open:array<struct<at:int,base:int,parens:int,begun:boolean,kind:string,name:string>>,done:array<struct<at:int,to:int,kind:string,name:string>>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, within a lambda too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bare_code(content: Column, lang: str) -> Column:
    """A source text with blanks for comments and texts; every line and place stays where it was."""
    pieces = F.regexp_extract_all(content, F.lit(rf"""{QUIET[lang]}|[^"'`/]++|["'`/]"""), F.lit(0))
    quiet = lambda p: (F.length(p) > 1) & p.rlike(r"""^["'`/]""")
    return F.array_join(F.transform(pieces, lambda p: F.when(quiet(p), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def _begins(lang: str, x: Column) -> Column:
    """kind and name of the definition that line x begins in a language; null without one."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("name")))
    if lang in ("typescript", "javascript"):  # types of parameters may hold semicolons
        x = F.when(x.contains(";"), F.regexp_replace(x, r"\{[^{}()]*+\}", "{}")).otherwise(x)
    for pattern, kind in DEFINITION_RULES[lang]:
        out = out.when(x.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, pattern, 1).alias("name")))
    return out


def definition_spans(lang: str, bare: Column) -> Column:
    """array<struct<at,to,kind,name>> of the definitions in lines of bare_code(), from 0, to exclusive, by first line.

    One pass over the lines that carries the depth of braces and parentheses and the
    definitions still open: a body ends where the depth is back at that of its signature,
    however its lines are indented. A signature may go on over lines until its parentheses
    close. Without a body a definition ends with its statement; unclosed ones end with the file.
    """
    sure, maybe = SIGNATURES[lang]
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    lines = F.transform(bare, lambda x, i: F.struct(i.cast("int").alias("at"), x.alias("line"), F.get(bare, i + 1).alias("next"), (count(x, "{") - count(x, "}")).alias("braces"), count(F.regexp_extract(x, r"^[^{]*", 0), "}").alias("lead"), (count(x, "(") - count(x, ")")).alias("parens")))

    def ended(x: Column, text: Column) -> Column:
        """Whether a statement without an open body is over with line x."""
        more = F.coalesce(x["next"], F.lit("")).rlike(r"^\s*(?:[{|&=?:.]|(?:extends|implements|permits|throws)\b)")
        return text.rlike(r"\{.*\}\s*[;,]?\s*$") | (~text.contains("{") & text.rlike(r"[^(,=|&?:\s]\s*$") & ~text.rlike(r"=>\s*$") & (~more | text.rlike(r";\s*$")))

    def step(s: Column, x: Column) -> Column:
        after, dip, parens = s["depth"] + x["braces"], s["depth"] - x["lead"], s["parens"] + x["parens"]
        call = (parens > s["sig_parens"]) & x["line"].rlike(r";\s*$|=>\s*\{\s*$|\bfunction\b") & ~s["sig"].rlike(sure)
        goes_on = s["sig"].isNotNull() & ~F.coalesce(call, F.lit(False))
        text = F.struct(
            F.when(goes_on, F.concat(s["sig"], F.lit(" "), F.ltrim(x["line"]))).otherwise(x["line"]).alias("text"),
            F.when(goes_on, s["sig_at"]).otherwise(x["at"]).alias("at"),
            F.when(goes_on, s["sig_base"]).otherwise(dip).alias("base"),
            F.when(goes_on, s["sig_parens"]).otherwise(s["parens"]).alias("parens"),
        )

        def judged(t: Column) -> Column:
            waits = (parens > t["parens"]) & (t["text"].rlike(sure) | t["text"].rlike(maybe))
            return _let(F.struct(waits.alias("waits"), F.when(~waits, _begins(lang, t["text"])).alias("d")), lambda j: moved(t, j))

        def moved(t: Column, j: Column) -> Column:
            new = F.struct(t["at"].alias("at"), t["base"].alias("base"), t["parens"].alias("parens"), (after > t["base"]).alias("begun"), j["d"]["kind"].alias("kind"), j["d"]["name"].alias("name"))
            over = lambda o: F.when(o["begun"], F.least(dip, after) <= o["base"]).otherwise((after < o["base"]) | ((after == o["base"]) & (parens <= o["parens"]) & ended(x, x["line"])))
            at_once = (after <= t["base"]) & ended(x, t["text"])
            gone = F.concat(F.filter(s["open"], over), F.when(j["d"].isNotNull() & at_once, F.array(new)).otherwise(F.array().cast("array<struct<at:int,base:int,parens:int,begun:boolean,kind:string,name:string>>")))
            still = F.transform(F.filter(s["open"], lambda o: ~over(o)), lambda o: F.struct(o["at"].alias("at"), o["base"].alias("base"), o["parens"].alias("parens"), (o["begun"] | (after > o["base"])).alias("begun"), o["kind"].alias("kind"), o["name"].alias("name")))
            still = F.when(j["d"].isNotNull() & ~at_once, F.concat(still, F.array(new))).otherwise(still)
            ends = lambda g: F.concat(s["done"], F.transform(g, lambda o: F.struct(o["at"].alias("at"), (x["at"] + 1).alias("to"), o["kind"].alias("kind"), o["name"].alias("name"))))
            done = _let(gone, lambda g: F.when(F.size(g) == 0, s["done"]).otherwise(ends(g)))
            idle = (F.size(s["open"]) == 0) & j["d"].isNull()
            held = [F.when(j["waits"], v).alias(n) for n, v in (("sig", t["text"]), ("sig_at", t["at"]), ("sig_base", t["base"]), ("sig_parens", t["parens"]))]
            return F.struct(after.alias("depth"), parens.alias("parens"), *held, F.when(idle, s["open"]).otherwise(still).alias("open"), F.when(idle, s["done"]).otherwise(done).alias("done"))

        return _let(text, judged)

    start = F.from_json(F.lit('{"depth":0,"parens":0,"open":[],"done":[]}'), _FOLDED)
    rest = lambda s: F.transform(s["open"], lambda o: F.struct(o["at"].alias("at"), F.size(bare).alias("to"), o["kind"].alias("kind"), o["name"].alias("name")))
    return F.aggregate(lines, start, step, lambda s: F.array_sort(F.concat(s["done"], rest(s))))


def _bodies(lang: str, content: Column) -> Column:
    """definition_spans() of a text with each one's body and, for functions, what of its code is in no inner one."""

    def of(lines: Column, bare: Column, spans: Column) -> Column:
        def each(s: Column, k: Column) -> Column:
            cut = lambda c: F.slice(c, s["at"] + 1, s["to"] - s["at"])
            # Definitions begin on lines of their own, so that a body of n lines holds fewer than n.
            inner = F.filter(F.slice(spans, k + 2, s["to"] - s["at"]), lambda t: t["at"] < s["to"])
            own = _let(inner, lambda held: F.array_join(F.filter(cut(bare), lambda x, i: ~F.exists(held, lambda t: (t["at"] <= i + s["at"]) & (i + s["at"] < t["to"]))), "\n"))
            return F.struct(s["at"].alias("at"), s["to"].alias("to"), s["kind"].alias("kind"), s["name"].alias("name"), F.array_join(cut(lines), "\n").alias("raw"), F.when(s["kind"].isin("function", "method"), own).alias("own"))

        return F.transform(spans, each)

    return _let(F.split(content, "\n"), lambda lines: _let(F.split(bare_code(content, lang), "\n"), lambda bare: _let(definition_spans(lang, bare), lambda spans: of(lines, bare, spans))))


def _code_definitions(files: DataFrame, lang: str) -> DataFrame:
    of = files.where(F.col("language") == lang).select("repo_id", "path", "language", "content")
    # An inner explode would have its input's size filtered on, and the bodies found again for that.
    each = of.select("repo_id", "path", "language", F.explode_outer(_bodies(lang, F.col("content"))).alias("def")).where("def is not null")
    text, name = F.col("def.own"), F.col("def.name")
    after = F.coalesce(F.nullif(F.instr(text, F.concat(name, F.lit("("))), F.lit(0)), F.instr(text, name)) + F.length(name)
    said = F.substring(text, after, F.length(text))
    said = said if lang == "java" else F.regexp_replace(said, r"\bnew\s+[\w$.]+", "")
    called = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(said, F.lit(CALL), 1), callee_name), lambda c: (c != "") & ~c.isin(NOT_CALLS)))
    none = F.array().cast("array<string>")
    defs = each.select("repo_id", "path", "language", F.col("def.kind").alias("chunk_type"), name.alias("symbol"), (F.col("def.at") + 1).alias("start_line"), F.col("def.to").alias("end_line"), F.col("def.raw").alias("raw"), F.when(text.isNotNull(), called).otherwise(none).alias("calls"))

    lined = of.withColumn("lines", F.split("content", "\n"))
    if lang == "go":
        lined = lined.withColumn("first", F.coalesce(F.array_min(F.transform("lines", lambda x, i: F.when(x.rlike(r"^(?:func|type)\b"), i))), F.size("lines")))
    listed = (lambda x, i: x.rlike(GO_IMPORT) & (i < F.col("first"))) if lang == "go" else (lambda x, i: F.lit(False))
    marked = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(IMPORT_LINE) | listed(x, i), F.struct(i.alias("at"), x.alias("line")))), lambda s: s.isNotNull())
    stated = F.transform("im", lambda s: s["line"]) if lang in ("java", "go") else F.regexp_extract_all("content", F.lit(JS_IMPORT), 0)
    modules = F.array_distinct(F.filter(F.transform(stated, lambda x: import_module(F.col("language"), x)), lambda m: m != ""))
    imports = lined.withColumn("im", marked).where(F.size("im") > 0).select("repo_id", "path", "language", F.lit("import").alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), (F.get("im", F.lit(0))["at"] + 1).alias("start_line"), (F.element_at("im", -1)["at"] + 1).alias("end_line"), F.array_join(F.transform("im", lambda s: s["line"]), "\n").alias("raw"), modules.alias("calls"))
    return defs.unionByName(imports)


def code_definitions(files: DataFrame) -> DataFrame:
    """As python_definitions, for Go, Java, TypeScript and JavaScript, by rules over lines and the depth of braces.

    Signatures must name their definition on their first line and may go on below it. What comments and texts
    hold is no code. Functions without a name of their own (arrow functions) count for what encloses them, calls in
    definitions inside another for the inner one. Null contents give no rows. No shuffle, native columns only.
    """
    parts = [_code_definitions(files.where("content is not null"), lang) for lang in DEFINITION_RULES]
    return reduce(DataFrame.unionByName, parts)


def chunk_definition_lines(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of code_definitions(). No shuffle."""
    return finished(code_definitions(files), max_chars)


def _python_definitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        out = []
        for f in files.itertuples(index=False):
            try:
                tree = ast.parse(f.content or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            lines = (f.content or "").split("\n")

            def add(kind, name, start, end, calls, f=f, lines=lines):
                out.append((f.repo_id, f.path, f.language, kind, name, start, end, "\n".join(lines[start - 1 : end]), calls))

            def walk(node, in_class, add=add):
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        calls, todo = [], list(ast.iter_child_nodes(child))
                        while todo:  # not into nested definitions
                            x = todo.pop(0)
                            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                                continue
                            if isinstance(x, ast.Call):
                                calls.append(x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", ""))
                            todo += ast.iter_child_nodes(x)
                        add("method" if in_class else "function", child.name, child.lineno, child.end_lineno, [c for c in dict.fromkeys(calls) if c])
                        walk(child, False)
                    elif isinstance(child, ast.ClassDef):
                        add("class", child.name, child.lineno, child.end_lineno, [])
                        walk(child, True)
                    else:
                        walk(child, in_class)

            walk(tree, False)
            found = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
            if found:
                names = [a.name for n in found if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in found if isinstance(n, ast.ImportFrom)]
                add("import", None, min(n.lineno for n in found), max(n.end_lineno for n in found), [m for m in dict.fromkeys(names) if m])
        yield pd.DataFrame(out, columns=["repo_id", "path", "language", "chunk_type", "symbol", "start_line", "end_line", "raw", "calls"])


def python_definitions(files: DataFrame) -> DataFrame:
    """Functions, methods, classes and one import block of Python files, with the names that they call or import."""
    rows = files.where("language = 'python'").select("repo_id", "path", "language", "content")
    return rows.mapInPandas(_python_definitions, "repo_id string, path string, language string, chunk_type string, symbol string, start_line int, end_line int, raw string, calls array<string>")


def chunk_definitions(files: DataFrame, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges): definitions of all code languages, and what they call (CALLS) or their file imports (IMPORTS)."""
    own = python_definitions(files).unionByName(code_definitions(files))
    chunks = finished(own, max_chars)
    node = stable_id(*[F.col(c) for c in ("repo_id", "path", "chunk_type", "start_line", "end_line", "symbol")])
    edges = own.select("repo_id", node.alias("from_node"), F.when(F.col("chunk_type") == "import", "IMPORTS").otherwise("CALLS").alias("edge_type"), F.explode("calls").alias("to_symbol"), F.col("start_line").alias("line"))
    return chunks, edges.withColumn("edge_id", stable_id(*[F.col(c) for c in ("repo_id", "edge_type", "from_node", "to_symbol", "line")]))


def chunk_files(files: DataFrame) -> DataFrame:
    """Every file by its language's chunker; files of unknown languages give no chunks."""
    from ..functions.paths import chunk_route

    routed = files.withColumn("route", chunk_route(F.col("language")))
    code, _ = chunk_definitions(routed.where("route = 'code'"))
    return code.unionByName(chunk_headings(routed.where("route = 'headings'"))).unionByName(chunk_lines(routed.where("route = 'lines'")))


def error_excerpt(logs: DataFrame, keys: list[str], log_col: str = "log", before: int = 5, after: int = 10, tail: int = 150, max_chars: int = 8000) -> DataFrame:
    """keys, excerpt: error lines with what precedes them and the lines up to the last error's end, else the tail.

    Works on arrays of lines within a row, so that no log is shuffled by line.
    """
    from ..functions.text import clean_log_line

    lined = logs.withColumn("lines", F.transform(F.split(F.col(log_col), "\n"), clean_log_line)).withColumn("n", F.size("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.contains("##[error]"), i)), lambda i: i.isNotNull())
    lined = lined.withColumn("errors", at).withColumn("last", F.array_max("errors"))
    lined = lined.withColumn("end", F.coalesce(F.least(F.col("n") - 1, F.col("last") + after), F.col("n") - 1)).withColumn("begin", F.greatest(F.lit(0), F.when(F.col("last").isNull(), F.col("n") - tail).otherwise(F.col("end") - tail)))
    around = F.flatten(F.transform("errors", lambda e: F.sequence(F.greatest(F.lit(0), e - before), e)))
    lined = lined.withColumn("kept", F.array_sort(F.array_distinct(F.concat(around, F.sequence("begin", "end")))))
    text = F.transform("kept", lambda i, k: F.concat(F.when((k > 0) & (F.get("kept", k - 1) != i - 1), F.lit("…\n")).otherwise(F.lit("")), F.get("lines", i)))
    out = trim(F.array_join(text, "\n"))
    return lined.select(*keys, F.when(F.length(out) > max_chars, F.concat(F.lit("…"), F.substring(out, F.length(out) - max_chars + 2, F.lit(max_chars)))).otherwise(out).alias("excerpt"))


def running_stage(events: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """Events whose rank is above every earlier one of their key."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("seen", F.max(rank).over(before)).where(F.col("seen").isNull() | (F.col(rank) > F.col("seen"))).drop("seen")
