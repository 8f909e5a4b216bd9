"""Files and contents that are withheld whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.sources.catalog import FILE_EXTENSION_RULES

# What an environment file looks like, and how many such lines make one.
ASSIGNMENT_LINE = "(?md)^[A-Z_]+=.+$"
ASSIGNMENT_LINES = 3


def base_name(path: Column) -> Column:
    """Last element of a path; slashes at its end do not count."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)


def extension(path: Column) -> Column:
    """From the last dot of the last element, or empty."""
    return F.regexp_extract(base_name(path), r"\.[^.]*$", 0)


def file_is_blocked(path: Column, extensions: list[str]) -> Column:
    listed = [e.lower() for e in extensions]
    base = F.lower(base_name(path))
    return (
        F.lower(extension(path)).isin(*listed) | F.concat(F.lit("."), base).isin(*listed) | base.isin(*listed)
    )


def content_is_blocked(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ASSIGNMENT_LINE)) >= ASSIGNMENT_LINES


def file_placeholder(path: Column) -> Column:
    return F.concat(F.lit("[REDACTED-FILE-"), extension(path), F.lit(": "), base_name(path), F.lit("]"))


def block_texts(texts: DataFrame, extensions: list[str], contents: bool = True) -> DataFrame:
    """``(id, path, text)``: a blocked text becomes its placeholder, with ``blocked`` and ``reason``."""
    by_file = F.coalesce(file_is_blocked(F.col("path"), extensions), F.lit(False))
    by_content = F.coalesce(content_is_blocked(F.col("text")), F.lit(False)) & F.lit(contents)
    reason = F.when(by_file, F.lit("blocked file")).when(by_content, F.lit("blocked content")).otherwise("")
    decided = texts.withColumn("reason", reason).withColumn("blocked", F.col("reason") != "")
    return decided.withColumn("text", F.when(F.col("blocked"), file_placeholder(F.col("path"))).otherwise(F.col("text")))


def blocked_extensions(
    user: list[str], effective: dict[str, bool], content_flag: bool
) -> tuple[list[str], bool]:
    """Default extensions whose rule is on, then the user's own; and whether contents are looked at."""
    own = [e for e in user if e.lower() not in FILE_EXTENSION_RULES]
    return (
        [ext for ext, rule in FILE_EXTENSION_RULES.items() if effective.get(rule, False)] + own,
        content_flag and effective.get("file_block_content_patterns", False),
    )
