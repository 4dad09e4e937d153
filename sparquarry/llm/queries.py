"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import conversation_digests, format_conversations
from .common import ascii_lower, stored
from .decontamination import contamination
from .fill_in_middle import fill_in_middle, restored_text
from .merkle import merkle_manifest
from .minhash import near_duplicates
from .mixing import mixture
from .quality import quality
from .quality_rules import quality_rules
from .sentence_dedup import drop_repeated_spans
from .simhash import simhash_near_duplicates
from .token_output import encoded_corpus
from .toxicity import toxicity
from .url_filters import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convolutional classifier over whole texts, fitted on labels.toxic outside the held-out fold."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles of whole texts; links from a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


#: All pairs by shared shingles, and what each document reaches over links.
ORACLES["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM either UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a
), least_ AS (
  SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ l USING (doc_id)
"""


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as ids of the byte-level vocabulary, written as coded blocks and read back."""
    import public_tokenizers

    back = encoded_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, digests=True)
    return back.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-indexing pools and a two-layer network, fitted on labels.quality outside the held-out fold."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers by language and source over whole texts."""
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by sources that weigh 1, 2, 3, repeating; at most three times a source's size."""
    return mixture(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)


#: Sources by code point weigh 1, 2, 3, repeating. Sorted by cap over weight, the sources cut to their caps come first.
ORACLES["op3_mixing_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / greatest(0.1::DOUBLE, CASE WHEN length(text) > 0 THEN 1 - len(regexp_extract_all(text, '[!-&*+/-9<-@\[-`{-~]'))::DOUBLE / length(text) ELSE 0.1::DOUBLE END) AS key
  FROM docs
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [1, 2, 3][place % 3 + 1]::DOUBLE AS weight, 3::DOUBLE * source_size AS cap FROM sources
), run AS (
  SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS whole,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed
), shared AS (
  SELECT *, (whole - capped) / open_weight AS share, ratio < (whole - capped) / open_weight AS is_cut FROM run
), level AS (
  SELECT share FROM shared WHERE NOT is_cut ORDER BY ratio, place LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN is_cut THEN cap ELSE (SELECT share FROM level) * weight END AS target FROM shared
), ordered AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, floor(target - epochs * source_size) - upto + size)) AS BIGINT) AS taken
FROM ordered
"""


#: The rules of the query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and redirect equivalence over every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


ORACLES["op2_url_filters"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut
), fits AS (
  SELECT *, '.' || host AS dotted FROM parts
)
SELECT page_id, host, path,
  CASE WHEN dotted LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
       WHEN dotted LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
       WHEN dotted LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
       WHEN dotted LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
       WHEN dotted LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule,
  CASE WHEN dotted LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'allow'
       WHEN (dotted LIKE '%.com' AND path LIKE '/en/%') OR (dotted LIKE '%.net' AND path LIKE '/de/%') OR (dotted LIKE '%.org' AND path LIKE '/es/%') THEN 'block'
       ELSE 'allow' END AS verdict
FROM fits
"""


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted, stored and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    formatted = stored(format_conversations(turns.unionByName(extra)), "chat")
    return conversation_digests(formatted)


ORACLES["op6_chat_formatting"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '<\|')) + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '<</?SYS>>')) + len(regexp_extract_all(text, '\[/?INST\]')) AS n
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + n + 7 + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item by spaced seeds."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All equal tokens by diagonal, and the most of them in any 16 places of a row (all of a shorter item).
ORACLES["op7_benchmark_decontamination"] = r"""
WITH dt AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents
), it AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark
), dw AS (
  SELECT doc_id, len(t) AS m, unnest(t) AS w, generate_subscripts(t, 1) AS j FROM dt
), iw AS (
  SELECT item_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM it WHERE len(t) >= 5
), same AS (
  SELECT doc_id, item_id, n, m, j - i AS off, i FROM dw JOIN iw USING (w)
), diagonals AS (
  SELECT * FROM same WHERE least(n, m - off) - greatest(0, -off) >= least(n, 16) QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, off) * 100 >= 80 * least(n, 16)
), counted AS (
  SELECT doc_id, item_id, least(n, 16) AS length, count(*) OVER (PARTITION BY doc_id, item_id, off ORDER BY i RANGE BETWEEN 15 PRECEDING AND CURRENT ROW) AS best FROM diagonals
), bad AS (
  SELECT doc_id, item_id, max(best / length) AS share FROM counted WHERE 100 * best >= 80 * length GROUP BY doc_id, item_id
  UNION ALL SELECT doc_id, item_id, 1.0::DOUBLE FROM dt JOIN it ON dt.t = it.t AND len(it.t) BETWEEN 1 AND 4
), by_doc AS (
  SELECT doc_id, list_sort(list_distinct(list(item_id))) AS items, max(share) AS overlap FROM bad GROUP BY doc_id
)
SELECT doc_id, items IS NOT NULL AS contaminated, items IS NULL AS kept, items, overlap FROM documents LEFT JOIN by_doc USING (doc_id)
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in repeated runs removed from all documents but the first."""
    return drop_repeated_spans(table(spark, sf_dir, "documents"), least=2, least_words=0)


#: Sentences, runs of two, the first place of each run, and what is left without the sentences of later ones.
ORACLES["op8_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\n]+?(?:[.!?]+[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+|\n[\x09-\x0D\x1C-\x20\x{85}\x{A0}]*|\z)') AS u FROM documents
), sentences AS (
  SELECT doc_id, unnest(u) AS s, generate_subscripts(u, 1) AS i FROM split
), plain AS (
  SELECT doc_id, i, s, regexp_replace(s, '^[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+$', '', 'g') AS p FROM sentences
), runs AS (
  SELECT doc_id, i, p, lead(p) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM plain
), placed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY p, q ORDER BY doc_id NULLS LAST, i) AS nth, first_value(doc_id) OVER (PARTITION BY p, q ORDER BY doc_id NULLS LAST, i) AS first_doc FROM runs WHERE q IS NOT NULL
), late AS (
  SELECT doc_id, i, first_doc FROM placed WHERE nth > 1
), gone AS (
  SELECT doc_id, i FROM late UNION SELECT doc_id, i + 1 FROM late
), left_ AS (
  SELECT p.doc_id, count(*) AS n, count(g.i) AS r, coalesce(string_agg(s, '' ORDER BY p.i) FILTER (g.i IS NULL), '') AS rest FROM plain p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
), firsts AS (
  SELECT doc_id, list_sort(list_distinct(list(first_doc))) AS first_docs FROM late GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, first_docs, coalesce(r < n, true) AS kept, CASE WHEN r > 0 THEN rest ELSE d.text END AS text
FROM documents d LEFT JOIN left_ USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a leaf; a fifth of them handed in with their letters lower-cased, held against the root."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), claims={"text": tampered})


#: Levels of each source's tree, then of the tree over the subroots; crc32 bit by bit; a fold for each level.
ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE strlen(text) || ':' || text END, '-')) AS claim
  FROM given
), nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16
), subroots AS (
  SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16
), siblings AS (
  SELECT l.doc_id, n.level, n.pos, n.digest, n.pos < (l.pos >> (4 * n.level)) AS before, n.pos = (l.pos >> (4 * n.level)) AS own
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.pos >> 4 = l.pos >> (4 * (n.level + 1)) WHERE n.n > 1
  UNION ALL
  SELECT l.doc_id, s.height + t.level, t.pos, t.digest, t.pos < (s.pos >> (4 * t.level)), t.pos = (s.pos >> (4 * t.level))
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops t ON t.pos >> 4 = s.pos >> (4 * (t.level + 1)) WHERE t.n > 1
), steps AS (
  SELECT doc_id, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (before), '') AS b, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (NOT before AND NOT own), '') AS a
  FROM siblings GROUP BY doc_id, level
), folds AS (
  SELECT doc_id, 0 AS level, claim AS cur FROM leaves
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(s.b || f.cur || s.a) FROM folds f JOIN steps s ON f.doc_id = s.doc_id AND f.level = s.level
), proofs AS (
  SELECT doc_id, sha256(string_agg(b || a, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id
), ends AS (
  SELECT doc_id, max_by(cur, level) AS folded_root FROM folds GROUP BY doc_id
)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT digest AS root FROM tops WHERE n = 1)
"""


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles of whole texts; links from two differing bits down."""
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, most=2)


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut after two of its lines, and made whole again from the output."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op13_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
