"""Scalar column functions over texts, paths and ids; all built from Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for a glob (``*``, ``?`` and literal characters)."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c not in "_/-" else c for c in pattern) + "$"


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    """Physical lines: a final line feed opens no further line; null and empty texts have none."""
    pieces = F.size(line_array(text))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(pieces - F.when(text.endswith("\n"), 1).otherwise(0))


def snippet(text: Column, line: Column, context: int) -> Column:
    """The lines within ``context`` of a 1-based line, joined by line feeds; null outside the text."""
    first = F.greatest(line - context, F.lit(1))
    part = F.slice(line_array(text), first, line + context - first + 1)
    return F.when((line >= 1) & (line <= F.size(line_array(text))), F.array_join(part, "\n"))


def area(path: Column, depth: int = 2) -> Column:
    """The first components of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def naming_convention(name: Column) -> Column:
    """kebab-case, PascalCase, camelCase, snake_case, flat_lower or null, from the name without extension."""
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    lower, dash = stem == F.lower(stem), stem.contains("-")
    first = F.substring(stem, 1, 1)
    return (
        F.when(F.length(stem) == 0, F.lit(None))
        .when(dash & lower, "kebab-case")
        .when(~dash & first.rlike("[A-Z]"), "PascalCase")
        .when(~dash & first.rlike("[a-z]") & stem.rlike("[A-Z]"), "camelCase")
        .when(stem.contains("_") & lower, "snake_case")
        .when(~dash & lower & stem.rlike("[a-z]"), "flat_lower")
    )


#: Words and openings that mark a value as a placeholder.
PLACEHOLDER_WORDS = ["", "changeme", "xxx", "yyy", "zzz", "placeholder", "test", "example", "dummy", "none", "null", "undefined", "todo", "fixme"]
PLACEHOLDER_OPENINGS = ["your-", "your_", "<", "${", "{{"]
FIELD_NAME = "^[a-z][a-z0-9]*(_[a-z0-9]+)+$"


def is_placeholder(value: Column) -> Column:
    """Whether a value stands for a secret that is not there: known words, openings, short values, labels."""
    low = F.trim(F.lower(value))
    opened = F.lit(False)
    for opening in PLACEHOLDER_OPENINGS:
        opened = opened | low.startswith(opening)
    bare = F.trim(value)
    label = bare.rlike(FIELD_NAME) | bare.contains(" ") | (bare.rlike(r"[@:/\s]") & (bare == F.lower(bare)))
    return low.isin(PLACEHOLDER_WORDS) | opened | (F.length(value) < 8) | (F.length(bare) == 0) | label


def word_set(text: Column) -> Column:
    """Sorted distinct lower-case alphanumeric words of at least three characters."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct elements; two empty arrays give 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def shortened(text: Column, most: int) -> Column:
    """At most so many characters; a cut shows as an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def elapsed_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours between two times."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))) / 86400)
