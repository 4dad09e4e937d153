"""Questions, messages, logs and answers as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a question, and patterns of messages, logs and answers.
STOPWORDS = ["the", "a", "an", "is", "are", "how", "what", "where", "why", "when", "does", "do", "to", "of", "in", "on", "for", "and", "or", "with", "this", "that", "i", "we", "you", "it", "can", "please", "show", "me", "find", "code", "function", "class", "method", "repo", "repository"]
EXACT_STOPWORDS = ["code", "converted", "generated", "into", "question", "questions", "search"]
SCOPE_STOPWORDS = ["the", "and", "for", "with", "this", "that", "then", "does", "work", "file", "files", "import", "imports", "repo", "repository"]
SYMBOL_PATTERNS = [r"`([^`]+)`", r"\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_.]+)\b", r"\b([a-z]+[A-Z][A-Za-z0-9]*)\b", r"\b([A-Z][a-z0-9]+[A-Za-z0-9]*)\b", r"\b([a-z][a-z0-9]*_[a-z0-9_]+)\b"]
QUESTION_INTENTS = [("definition", r"\b(where|defined|definition|declare)\b"), ("usage", r"\b(call|called|use|usage|used|invoke)\b"), ("explanation", r"\b(how|why|explain|what does|walk me)\b")]
PR_URL = r"(?i)https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)/pull/(\d+)"
PR_SHORT = r"\b([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)#(\d+)\b"
NOTIFY = r"(?i)^\s*notify\s+([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\s+(?:in\s+)?(?:(here)|<#([A-Z0-9]+)(?:\|[^>]*)?>)\s*$"
INDEX_REPO = r"(?i)^\s*(?:index|add)\s+(?:the\s+)?(?:repo(?:sitory)?\s+)?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\s*$"
INDEX_STATUS = r"(?i)^\s*index(?:ing)?\s+status\s*$"
CREATE_PR = r"(?i)\b(create|open|raise|make)\s+(a\s+)?(pr|pull\s+request)\b"
CREATE_PR_LINE = r"(?i)^\s*create\s+pr\s*:\s*"
REVIEW_VERB = r"(?i)\b(review|check|audit|look\s+at)\b"
DEEP_TRACE = r"(?i)\b(trace|callers?|callees?|references?|implementations?|where\s+used|call\s+graph|dependency\s+chain|root\s+cause|breaking\s+change|migration\s+plan|impact\s+analysis|across\s+repos?|cross[-\s]?repos?)\b"
CODE_FAILURES = [r"--- FAIL:", r"(?i)\(typecheck\)|undeclared name|unknown field|cannot use .+ as|syntax error", r"error TS\d+", r"(?i)AssertionError|assertion failed", r"(?i)compilation (error|failed)"]
TRANSIENT = [
    ("network error", r"(?i)ETIMEDOUT|ECONNRESET|ECONNREFUSED|EAI_AGAIN"), ("network error", r"(?i)could not resolve host|tls handshake"), ("rate limit", r"(?i)\b429\b|too many requests|rate limit"), ("out of memory", r"(?i)out of memory|\bOOM\b|exit code 137"),
    ("container registry", r"(?i)toomanyrequests|error pulling image|failed to pull (the )?image"), ("runner disk full", r"(?i)no space left on device"), ("runner infrastructure", r"(?i)lost communication with the server|runner has received a shutdown signal"),
    ("timeout", r"(?i)\btimed out\b|\btimeout exceeded\b|exceeded the maximum execution time|deadline exceeded"),
]
SERVICE_TRANSIENT = r"(?i)\b(3040|429|503|504|7505)\b|capacity temporarily exceeded|temporarily unavailable|rate[ -]limit|throttl"
BREAKING = r"(?i)\b(breaking|cross[-\s]?repo|multi[-\s]?repo|migration|migrate all|all consumers|downstream|dependenc(?:y|ies)|major version|api change|schema change)\b"
PATHS = r"\b[\w.-]+(?:/[\w.-]+)+\.(?:ts|tsx|js|jsx|mjs|cjs|go|py|rb|java|rs|sql|toml|ya?ml|json)\b"
ABSTENTIONS = [
    r"\bi (cannot|can't|could not|couldn't) answer (this|that)? ?(question )?(from|using) (the )?(provided )?context\b", r"\bcontext (does not|doesn't|did not|didn't) (contain|include|show|provide|cover)\b",
    r"\bprovided context (does not|doesn't|did not|didn't) (contain|include|show|provide|cover)\b", r"\bretrieved (documents|files|snippets|context) (do not|don't|does not|doesn't) (cover|contain|include|show)\b",
    r"\bnone of the (retrieved|provided) (documents|files|snippets|context|context blocks) (describe|cover|contain|include|show)\b", r"\bi (could not|couldn't|cannot|can't) find\b", r"\bi do not see\b|\bi don't see\b",
    r"\bnot enough (context|information|evidence)\b", r"\bwould need access to\b",
]
#: Secrets by rule; the first group, if any, is kept.
SECRETS = {"aws_access_key_id": r"\bAKIA[0-9A-Z]{16}\b", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "assigned_secret": r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']"}


#: A word's edge among letters, digits and _ of ASCII alone; Java's \\b may take other letters for part of a word.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """A pattern with EDGE for its word edges."""
    return pattern.replace(r"\b", EDGE)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_of(x: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern x holds, else null."""
    return reduce(lambda acc, r: acc.when(x.rlike(ascii_edges(r[1])), r[0]), rules[1:], F.when(x.rlike(ascii_edges(rules[0][1])), rules[0][0]))


def any_of(x: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | x.rlike(ascii_edges(p)), patterns[1:], x.rlike(ascii_edges(patterns[0])))


def symbols(question: Column) -> Column:
    """Up to 12 likely identifiers, pattern by pattern in order."""
    found = F.concat(*[F.regexp_extract_all(question, F.lit(ascii_edges(p)), 1) for p in SYMBOL_PATTERNS])
    return F.slice(F.array_distinct(F.filter(F.transform(found, trim), lambda s: (F.length(s) > 1) & ~F.lower(s).isin(STOPWORDS))), 1, 12)


def terms(question: Column) -> Column:
    """Up to 20 lower-cased keywords."""
    found = F.split(F.regexp_replace(F.lower(question), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))), 1, 20)


def question_intent(question: Column) -> Column:
    return F.coalesce(first_of(F.lower(question), QUESTION_INTENTS), F.lit("general"))


def _cut(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - n)


def singular(t: Column) -> Column:
    """A simple singular, or null."""
    n = F.length(t)
    return F.when(n <= 3, None).when(t.endswith("ies") & (n > 4), F.concat(_cut(t, 3), F.lit("y"))).when(t.endswith("ses") & (n > 4), _cut(t, 2)).when(t.rlike("(ches|shes|xes|zes)$"), _cut(t, 2)).when(t.endswith("s") & ~t.endswith("ss"), _cut(t, 1))


def present_tense(t: Column) -> Column:
    """A simple stem of a past tense, or null."""
    return F.when((F.length(t) <= 4) | ~t.endswith("ed"), None).when(t.endswith("ied"), F.concat(_cut(t, 3), F.lit("y"))).when(t.endswith("ated"), _cut(t, 1)).otherwise(_cut(t, 2))


def needles(syms: Column, words: Column, most: int = 10) -> Column:
    """What is searched for, in order: symbols, neighbouring terms as camelCase, terms each with its variants."""
    neighbours = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat(a, F.upper(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b))))
    variants = F.flatten(F.transform(words, lambda t: F.filter(F.array(t, singular(t), present_tense(t)), lambda v: v.isNotNull())))
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(syms, neighbours, variants), trim), lambda v: F.length(v) > 1)), 1, most)


def match_expression(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda n: F.concat(F.lit('"'), F.regexp_replace(n, '"', '""'), F.lit('"*'))), " OR ")


def exact_needles(question: Column) -> Column:
    """Up to 8 literal search terms: symbols, path-like words, terms; the first spelling of each stays."""
    paths = F.regexp_extract_all(question, F.lit(ascii_edges(r"\b([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)\b")), 1)
    found = F.filter(F.concat(symbols(question), paths, terms(question)), lambda v: (F.length(v) > 2) & ~F.lower(v).isin(EXACT_STOPWORDS))
    firsts = let(F.transform(found, F.lower), lambda low: F.filter(F.transform(found, lambda v, i: F.when(F.array_position(low, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull()))
    return F.slice(firsts, 1, 8)


def exact_query(question: Column) -> Column:
    """The literal terms joined by or, those with odd characters in quotes; the question itself without terms."""
    quoted = F.transform(exact_needles(question), lambda t: F.when(t.rlike("[^A-Za-z0-9_./-]"), F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(t, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))).otherwise(t))
    return F.coalesce(F.nullif(F.array_join(quoted, " or "), F.lit("")), trim(question))


def rank_needles(syms: Column, words: Column) -> Column:
    """Lower-cased terms and symbols with a naive singular each, over two characters."""
    values = F.concat(words, F.transform(syms, F.lower))
    both = F.flatten(F.transform(values, lambda v: F.array(v, F.when(v.endswith("s") & (F.length(v) > 3), _cut(v, 1)).otherwise(v))))
    return F.filter(F.array_distinct(both), lambda v: F.length(v) > 2)


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def message_intent(text: Column) -> Column:
    """What a chat message asks for; the order of the rules matters."""
    url, short = F.regexp_like(trim(text), F.lit(PR_URL)), text.rlike(PR_SHORT)
    return F.when(text.rlike(NOTIFY), "notify_repo").when(text.rlike(INDEX_STATUS), "index_status").when(text.rlike(INDEX_REPO), "index_repo").when(text.rlike(CREATE_PR) | text.rlike(CREATE_PR_LINE), "create_pr").when(url | (short & text.rlike(REVIEW_VERB)), "pr_review").otherwise("qa")


def pr_reference(text: Column) -> Column:
    """owner, repo and number of a pull request named in text; null without one."""

    def of(p: str) -> Column:
        return F.struct(F.regexp_extract(text, p, 1).alias("owner"), F.regexp_extract(text, p, 2).alias("repo"), F.try_to_number(F.regexp_extract(text, p, 3), F.lit("9999999999")).cast("long").alias("number"))

    return F.when(text.rlike(PR_URL), of(PR_URL)).when(text.rlike(PR_SHORT), of(PR_SHORT))


def index_target(text: Column) -> Column:
    """owner/name of a request to index a repo; null for other messages."""
    return F.nullif(F.regexp_extract(text, INDEX_REPO, 1), F.lit(""))


def notify_target(text: Column) -> Column:
    """repo and channel_id (null: here) of a request to notify; null for other messages."""
    found = F.struct(F.regexp_extract(text, NOTIFY, 1).alias("repo"), F.nullif(F.regexp_extract(text, NOTIFY, 3), F.lit("")).alias("channel_id"))
    return F.when(text.rlike(NOTIFY), found)


def needs_staged_plan(text: Column) -> Column:
    """Whether a change sounds as if it broke others."""
    return text.rlike(BREAKING)


def service_transient(error: Column) -> Column:
    """Whether a service's error passes by itself."""
    return F.coalesce(error.rlike(SERVICE_TRANSIENT), F.lit(False))


def deep_planning(question: Column, pool: Column, strong: Column, mode: str = "on_demand") -> Column:
    """Whether another search round is due: always, never, or for tracing questions and weak evidence."""
    if mode in ("always", "off"):
        return F.lit(mode == "always")
    return question.rlike(DEEP_TRACE) | ~((pool >= 8) & (strong >= 4))


def redact(text: Column) -> Column:
    """Secrets replaced by their rule's name in brackets."""
    return reduce(lambda x, r: F.regexp_replace(x, r[1], f"[REDACTED:{r[0]}]"), SECRETS.items(), text)


def secret_rules(text: Column) -> Column:
    """Names of the rules that text breaks, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]), lambda n: n.isNotNull())


def clean_log_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z ?", ""), "\x1b\\[[0-9;]*[A-Za-z]", "")


def top_error(excerpt: Column) -> Column:
    found = F.regexp_extract(excerpt, r"##\[error\][^\S\n]*(\S[^\n]*?)[^\S\n]*(?:\n|$)", 1)
    return F.when(found != "", found)


def transient_reason(excerpt: Column) -> Column:
    """Why a failure looks passing; null if it doesn't, or if the log shows that the code is broken."""
    return F.when(any_of(excerpt, CODE_FAILURES), F.lit(None)).otherwise(first_of(excerpt, TRANSIENT))


def log_paths(excerpt: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(excerpt, F.lit(f"({PATHS})"), 1)), 1, most)


def cited_markers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), 1), lambda x: x.cast("int")))


def abstains(answer: Column) -> Column:
    """Whether the first sentence, or its first 320 characters, says that there is no answer."""
    start = F.regexp_replace(answer, r"^\s+", "")
    lead = F.regexp_extract(start, r"^([\s\S]{0,320}?(?:[.!?](?=\s|$)|$))", 1)
    lead = F.when(lead != "", lead).otherwise(F.substring(start, 1, 320))
    return any_of(F.lower(lead), ABSTENTIONS)


def without_markers(answer: Column) -> Column:
    """An abstaining answer without citation markers; others as they are."""
    return F.when(abstains(answer), trim(F.regexp_replace(F.regexp_replace(answer, r"\s*\[(\d{1,2})\]", ""), r"[ \t]{2,}", " "))).otherwise(answer)


def clean_answer(text: Column) -> Column:
    """An assistant's text without its question line, markers and list of sources."""
    said = trim(F.regexp_replace(F.regexp_replace(text, r"^\*Q:\*[^\n]*\n+", ""), r"\[\d+\]", ""))
    return trim(F.get(F.split(trim(F.get(F.split(said, r"(?i)\n\s*\*?Sources\*?\s*\n"), F.lit(0))), r"(?i)\n\s*:robot_face:"), F.lit(0)))


def clean_turn(role: Column, text: Column) -> Column:
    """A turn's text for history: without mentions; 800 characters, or 1200 of an assistant."""
    plain = trim(F.regexp_replace(text, r"<@[A-Z0-9]+>", ""))
    out, most = F.when(role == "assistant", clean_answer(plain)).otherwise(plain), F.when(role == "assistant", 1200).otherwise(800)
    return F.when(F.length(out) > most, F.concat(F.substring(out, F.lit(1), most - 1), F.lit("…"))).otherwise(out)


def duration(ms: Column) -> Column:
    """<1s, x.y s under ten, whole seconds under a minute, then minutes and seconds."""
    s = F.greatest(F.lit(0.0), ms.cast("double")) / 1000
    tenth = F.regexp_replace(F.format_string("%.1f", F.floor(s * 10 + 0.5) / 10), r"\.0$", "")
    rest = F.floor(s - 60 * F.floor(s / 60) + 0.5)
    minutes, rest = F.floor(s / 60) + F.when(rest == 60, 1).otherwise(0), F.when(rest == 60, F.lit(0)).otherwise(rest)
    long = F.concat(minutes.cast("string"), F.lit("m"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("s"))).otherwise(F.lit("")))
    return F.when(s < 1, "<1s").when(s < 10, F.concat(tenth, F.lit("s"))).when(s < 60, F.concat(F.floor(s + 0.5).cast("string"), F.lit("s"))).otherwise(long)


def callee_name(call: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(call, r"\."), -1), r"([A-Za-z_$][A-Za-z0-9_$]*)", 1)


def import_module(lang: Column, line: Column) -> Column:
    java, py, quoted = F.regexp_extract(line, r"import\s+(?:static\s+)?([\w.*]+)", 1), F.regexp_extract(line, r"^\s*(?:from|import)\s+([\w.]+)", 1), F.regexp_extract(line, "[\"'`]([^\"'`]+)[\"'`]", 1)
    return F.when(lang == "java", java).when(lang == "python", py).otherwise(quoted)


def embedding_text(repo: Column, path: Column, lang: Column, kind: Column, symbol: Column, imports: Column, calls: Column, content: Column) -> Column:
    """Labelled lines, then the code; symbol, imports and calls only where there are some."""

    def some(label: str, x: Column) -> Column:
        return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"{label}: "), x))

    lines = [F.concat(F.lit("Repo: "), repo), F.concat(F.lit("Path: "), path), F.concat(F.lit("Language: "), F.coalesce(lang, F.lit("unknown"))), F.concat(F.lit("Chunk type: "), kind), some("Symbol", symbol), some("Imports", F.array_join(imports, ", ")), some("Calls", F.array_join(calls, ", ")), F.lit(""), F.lit("Code:"), content]
    return F.concat_ws("\n", *lines)


def first_json_object(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(\{[\s\S]*\})", 1)
