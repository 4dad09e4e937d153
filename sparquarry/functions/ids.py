"""Stable ids and encodings (native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them; null parts are empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def repo_id(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def valid_repo(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def short_number(text: Column) -> Column:
    """The first four bytes of the SHA-256 as a number; 1 for 0."""
    return F.greatest(F.lit(1), F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"))


def base64url(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def permalink(repo: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    parts = F.array_join(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(F.url_encode(p), r"\+", "%20")), "/")
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), commit, F.lit("/"), parts, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def citation_label(repo: Column, path: Column, start: Column, end: Column) -> Column:
    """name/path:start-end, without the repo's owner."""
    return F.concat(F.element_at(F.split(repo, "/"), -1), F.lit("/"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def artifact_id(repo: Column, commit: Column, kind: Column, lang: Column) -> Column:
    return F.concat_ws(":", repo, commit, kind, F.coalesce(F.nullif(lang, F.lit("")), F.lit("all")))


def artifact_uri(base: Column, repo: Column, commit: Column, kind: Column, local: Column) -> Column:
    """Below base, without its last slashes; the local path where there is no base."""
    root = F.nullif(F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", ""), F.lit(""))
    return F.when(root.isNull(), local).otherwise(F.concat_ws("/", root, F.regexp_replace(F.url_encode(repo), r"\+", "%20"), commit, kind))


def shard_prefix(repo: Column) -> Column:
    return F.regexp_replace(repo, "[^A-Za-z0-9_.-]+", "_")


def from_base64url(text: Column) -> Column:
    """The text behind base64 or base64url, padded or not."""
    plain = F.regexp_replace(F.translate(text, "-_\r\n", "+/"), "=+$", "")
    return F.decode(F.unbase64(F.rpad(plain, (4 * F.ceil(F.length(plain) / 4)).cast("int"), F.lit("="))), "UTF-8")


def set_hash(pairs: Column) -> Column:
    """Hash of a set of (name, hash) structs, whatever their order: a hash of hashes in name order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["hash"])), "\n"), 256)
