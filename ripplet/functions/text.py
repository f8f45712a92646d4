"""Scalar functions as columns: paths, urls, keys, rounding, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


#: Labels of an inventory's files, the first that fits.
INVENTORY = (
    (r"(?i)\.ya?ml$", "YAML"),
    (r"(?i)\.tf$", "HCL"),
    (r"(?i)\.(ts|tsx)$", "TypeScript"),
    (r"(?i)\.(js|jsx|mjs|cjs)$", "JavaScript"),
    (r"(?i)\.py$", "Python"),
    (r"(?i)\.go$", "Go"),
    (r"(?i)\.(json|lib)sonnet$", "Jsonnet"),
    (r"(?i)\.md$", "Markdown"),
)


def first_label(value: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that is found in value; null if none is."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in rules:
        out = out.when(value.rlike(pattern), label)
    return out


def language(path: Column) -> Column:
    """The inventory's label of a path; null for kinds that it doesn't count."""
    return first_label(F.replace(path, F.lit("\\"), F.lit("/")), INVENTORY)


def host(url: Column) -> Column:
    """Host, and port if it isn't the scheme's own, in lower case and without user info; "http" if a url has none."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]+)", 1))
    own = F.when(scheme == "http", ":80").when(scheme == "https", ":443").when(scheme == "ftp", ":21").otherwise(":none")
    return F.when(found == "", "http").when(F.endswith(found, own), F.regexp_replace(found, r":\d+$", "")).otherwise(found)


def route_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(60000.0), 2000.0 * F.pow(F.lit(4.0), F.greatest(F.lit(0), attempt - 1))).cast("long")


#: What makes a branch.
BRANCH = r"\b(if|else if|for|while|case|catch|&&|\|\||\?)\b"


def complexity(body: Column) -> Column:
    """1 + the branches of a body."""
    return F.lit(1) + F.regexp_count(body, F.lit(BRANCH))


def span(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, counted from 1."""
    lines = F.split(content, "\r?\n")
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")
