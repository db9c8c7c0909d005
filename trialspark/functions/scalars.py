"""Scalar functions of search analytics as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_rate(condition: Column) -> Column:
    """1 or 0 as a double, null for null; the mean of it is a rate."""
    return condition.cast("double")


def rate(condition: Column) -> Column:
    """The share of rows where condition holds, 0 over no rows."""
    return F.coalesce(F.avg(as_rate(condition)), F.lit(0.0))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The chance that k of n candidates, drawn without replacement, hold one of the c correct ones."""
    n, c, k = (x.cast("long") for x in (n, c, k))
    none_in = lambda a, i: F.when(i > k, a).otherwise(a * ((n - c - i + 1).cast("double") / (n - i + 1).cast("double")))
    missed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(1.0), none_in)
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(F.lit(1.0) - missed)


def tokens(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def truncated(text: Column, limit: int) -> Column:
    """text, or its first `limit` tokens joined by single blanks if it has more."""
    return F.when(token_count(text) > limit, F.array_join(F.slice(tokens(text), 1, limit), " ")).otherwise(text)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_bucket(key: Column, salt: str, buckets: int) -> Column:
    """The first eight bytes of the salted SHA-256, as an unsigned integer, modulo `buckets`."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key).cast("binary"), 256), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % F.lit(buckets)).cast("int")


def failure_class(stderr: Column) -> Column:
    """syntax_error, test_failure or runtime_error by what the error output names; null for null."""
    return F.when(stderr.contains("SyntaxError"), "syntax_error").when(stderr.contains("AssertionError"), "test_failure").when(stderr.isNotNull(), "runtime_error")


def trace_distance(a: Column, b: Column) -> Column:
    """Mismatches over the shorter trace and the gap in length, over the longer; 1 if a trace is empty."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, 1, F.greatest(short, F.lit(1))), F.slice(b, 1, F.greatest(short, F.lit(1))), lambda x, y: (x != y).cast("int"))
    return F.when(short == 0, 1.0).otherwise((F.aggregate(differ, F.lit(0), lambda s, x: s + x) + long - short).cast("double") / long)


def largest_cluster_ratio(sizes: Column) -> Column:
    """The largest of an array of cluster sizes over their sum; 0 if there are none."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total == 0, 0.0).otherwise(F.array_max(sizes) / total)


def top_two_margin(sizes: Column) -> Column:
    """The gap between the two largest sizes over the sum; 0 if there are none."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    falling = F.sort_array(sizes, asc=False)
    return F.when(total == 0, 0.0).otherwise((F.get(falling, F.lit(0)) - F.coalesce(F.get(falling, F.lit(1)), F.lit(0))) / total)


def path_component(text: Column) -> Column:
    """A file-name-safe form: other characters become _, ends lose ._-, nothing left is unknown."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(safe == "", "unknown").otherwise(safe)


def without_prefix(text: Column, prefix: Column) -> Column:
    """text without a leading prompt and the white space after it."""
    return F.when(text.startswith(prefix), F.regexp_replace(F.substr(text, F.length(prefix) + 1), r"^\s+", "")).otherwise(text)


def fenced_code(text: Column) -> Column:
    """The bodies of all fenced blocks, stripped, joined by a blank line; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)```(?:python|py)?\s*(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n\n"))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%.1f%%", x * 100))


def best_of_n_probability(p: Column, n: Column) -> Column:
    """The chance that one of n independent samples succeeds."""
    return 1.0 - F.pow(1.0 - p, n)


def repair_prompt(prompt: Column, attempt: Column, error: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nYour previous answer was:\n"), attempt, F.lit("\n\nIt failed with: "), F.coalesce(error, F.lit("no details")), F.lit("\nWrite a corrected answer."))


def plan_prompt(prompt: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nFirst list the steps you would take, without code."))


def revision_prompt(prompt: Column, attempt: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nChange as little as possible in this answer so that it becomes right:\n"), attempt)
