"""Names and paths, as built-in column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(name: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def archive_path(name: Column) -> Column:
    """Slashes as the archive has them."""
    return F.replace(name, F.lit("/"), F.lit("\\"))


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/\\]*$", 0)


def safe_path(name: Column, fallback: str = "unnamed.bin") -> Column:
    """A relative path that stays below its root: no empty, `.` or `..` parts; the fallback if nothing is left."""
    parts = F.filter(F.transform(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p)), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit(fallback))


def patch_prefix(prefix: Column) -> Column:
    """A prefix ending with one backslash; null for one of slashes and blanks."""
    bare = F.regexp_replace(archive_path(F.trim(prefix)), r"\\+$", "")
    return F.when(bare != "", F.concat(bare, F.lit("\\")))


def lines(text: Column) -> Column:
    """The trimmed lines of a list of names that aren't empty."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def glob_regex(pattern: str) -> str:
    """A pattern of `*` and `?` (one byte each) as a regular expression over the Latin-1 view of a name; ASCII case doesn't matter."""
    parts = {"*": ".*", "?": "."}
    return r"(?is)\A" + "".join(parts.get(c) or re.escape(c) for c in pattern.encode().decode("latin-1")) + r"\z"


def matches(name: Column, pattern: str) -> Column:
    """Whether a name fits a wildcard pattern, byte by byte."""
    return F.decode(F.encode(name, "UTF-8"), "ISO-8859-1").rlike(glob_regex(pattern))


def same_name(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)
