"""Text kernel: tokenisers, cleaning and counts as column expressions (SQL text, evaluated in the JVM)."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L

WORD = r"[\p{L}\p{N}_]+"
WORD_APOSTROPHE = rf"{WORD}(?:'{WORD})?"
SPAN_TOKEN = rf"{WORD_APOSTROPHE}|[.,!?;:\"'—–-]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case words with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_APOSTROPHE), F.lit(0))


def words(text: Column | str) -> Column:
    """Words; an apostrophe separates."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def span_tokens(text: Column | str) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(_col(text), F.lit(SPAN_TOKEN), F.lit(0))


def n_whitespace_words(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?U)\S+")).cast("long")


def n_integers(text: Column | str) -> Column:
    """Whole words that are digits only."""
    return F.size(F.filter(words(text), lambda w: w.rlike(r"^\p{Nd}+$"))).cast("long")


def n_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def anchor(pattern: str) -> str:
    """The longest piece of a phrase pattern that every match holds as it stands."""
    plain = re.sub(r"\\b|\(\?:[^)]*\)\??|.\?|\.\+", "\0", pattern)
    return max(plain.split("\0"), key=len)


def holds(low: Column, pattern: str) -> Column:
    """Whether the lower-case text matches; \\b and \\s are Unicode's, . stops at \\n only. The pattern is tried only where its anchor stands."""
    return low.contains(anchor(pattern)) & low.rlike(f"(?dU){pattern}")


def n_matches(text: Column | str, patterns: Iterable[str]) -> Column:
    """Matches of every pattern in the lower-case text, each tried only where its anchor stands."""
    return matches_in(F.lower(_col(text)), patterns)


def matches_in(low: Column, patterns: Iterable[str]) -> Column:
    """The same in a text that is lower-case."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.when(low.contains(anchor(p)), F.regexp_count(low, F.lit(f"(?dU){p}"))).otherwise(0)
    return total.cast("long")


def among(array: Column, values: Iterable[str]) -> Column:
    """How many elements are in a fixed set."""
    fixed = list(values)
    return F.size(F.filter(array, lambda w: w.isin(fixed))).cast("long")


def counts(array: Column) -> Column:
    """Occurrences of each distinct element, without a shuffle: run lengths of the sorted array."""
    sorted_ = F.sort_array(array)
    runs = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    ends = lambda s, b: F.transform(b, lambda x, i: F.coalesce(F.get(b, i + 1), F.size(s) + 1) - x)
    out = F.get(F.transform(F.array(sorted_), lambda s: F.get(F.transform(F.array(runs(s)), lambda b: ends(s, b)), F.lit(0))), F.lit(0))
    return F.when(F.size(array) > 0, out).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(sizes: Column, block: int = 256) -> Column:
    """Sums of what stands before each element of an array of sizes. Blocks are added up on their own, so that the work is not quadratic."""

    def within(z: Column) -> Column:
        def own(s: Column, b: Column) -> Column:
            part = F.aggregate(F.slice(z, b * block + 1, F.lit(block)), F.struct(s["at"].alias("at"), F.array().cast("array<bigint>").alias("out")), lambda t, x: F.struct((t["at"] + x).alias("at"), F.concat(t["out"], F.array(t["at"])).alias("out")))
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(s["out"], F.array(p["out"])).alias("out")))

        blocks = F.when(F.size(z) > 0, F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out")), own, lambda s: F.flatten(s["out"]))

    return let(sizes, within)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def entropy(count: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 for none."""
    n = total(count)
    return F.when(n > 0, F.log2(n) - F.aggregate(count, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n).otherwise(0.0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.arrow_udf(T.LongType())
def deflated(text: pa.Array) -> pa.Array:
    """Bytes of the text's UTF-8 compressed by zlib; Spark has no such function."""
    return pa.array([0 if not t else len(zlib.compress(t.encode("utf-8", "replace"))) for t in text.to_pylist()], pa.int64())


def end_of_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def stripped(text: Column) -> tuple[Column, Column, Column]:
    """Text without framing phrases, and how many prefixes and suffixes went. Each pattern acts on what the last one left."""
    before = after = F.lit(0)
    for p in L.PREFIXES:
        before = before + F.when(text.rlike(f"(?i){p}"), 1).otherwise(0)
        text = F.regexp_replace(text, f"(?i){p}", "")
    for p in L.SUFFIXES:
        after = after + F.when(text.rlike(f"(?id){p}"), 1).otherwise(0)
        text = F.regexp_replace(text, f"(?id){p}", "")
    return text, before.cast("long"), after.cast("long")


def without_header(text: Column) -> Column:
    return F.regexp_replace(text, r"^#+\s+[^\n]+\n+", "")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def inline_spaces(text: Column) -> Column:
    """Single spaces and no outer ones within each line."""
    return strip(F.array_join(F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n"))
