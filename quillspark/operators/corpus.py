"""Corpus audit, deduplication and leakage-free splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import stage
from . import ranks
from .documents import clean


def drop_malformed(df: DataFrame, min_words: int = 30, min_chars: int = 50) -> DataFrame:
    """Rows (with cleaned) of enough characters before cleaning and words after it."""
    out = clean(df)
    return out.where((F.length(X.strip(F.coalesce("text", F.lit("")))) >= min_chars) & ~F.col("is_empty") & (X.n_whitespace_words("cleaned") >= min_words))


def _first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the first by order (nulls last), of equal ones by all columns. A partial aggregate, so that a hot key stays small in the shuffle."""
    rank = F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(*df.columns))
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def exact_dedupe(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row of each cleaned text; a null one counts as empty."""
    return _first_of(df.withColumn("text_hash", F.sha2(F.coalesce("cleaned", F.lit("")), 256)), "text_hash", order)


def near_prefix(cleaned):
    """The first 60 characters in lower case without other than word characters; null where under 30 remain."""
    p = F.regexp_replace(F.lower(F.substring(cleaned, 1, 60)), r"[^\p{L}\p{N}_]+", "")
    return F.when(F.length(p) >= 30, p)


def near_dedupe(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Keeps the first of rows that begin alike; short beginnings are never dropped."""
    keyed = df.withColumn("_prefix", near_prefix(F.col("cleaned")))
    return _first_of(keyed.where("_prefix is not null"), "_prefix", order).unionByName(keyed.where("_prefix is null")).drop("_prefix")


def tallies(df: DataFrame, *columns: str) -> DataFrame:
    """column, value and rows of each value; a null value is written None."""
    found = [df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(c).alias("column"), "value", "rows") for c in columns]
    return reduce(DataFrame.unionByName, found)


def split_stats(df: DataFrame, group: str = "source", label: str = "label") -> DataFrame:
    """split, groups, rows, share of all rows, and rows of label 0 and 1."""
    own = df.groupBy("split").agg(F.countDistinct(group).alias("groups"), F.count("*").alias("rows"), F.count_if(F.col(label) == 0).alias("human"), F.count_if(F.col(label) == 1).alias("machine"))
    whole = own.agg(F.sum("rows").alias("_all"))  # one row of three at most
    return own.crossJoin(F.broadcast(whole)).select("split", "groups", "rows", (F.col("rows") / F.col("_all")).alias("share"), "human", "machine")


def integrity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and how many values of the columns are null, not a number, or infinite. All zero in a sound table."""
    count = lambda f: reduce(lambda a, b: a + b, [F.count_if(f(F.col(c).cast("double"))) for c in columns])
    return df.agg(F.count("*").alias("rows"), count(lambda c: c.isNull()).alias("nulls"), count(F.isnan).alias("nans"), count(lambda c: F.abs(c) == float("inf")).alias("infinite"))


def audit(df: DataFrame) -> DataFrame:
    """One row: rows in, dropped at each step, and kept. Texts are cleaned once: what passes is staged for the next step."""
    good = stage(drop_malformed(df).select("doc_id", "cleaned"))
    unique = stage(exact_dedupe(good))
    kept = near_dedupe(unique)
    n = lambda d, name: d.agg(F.count("*").alias(name))
    row = n(df, "total").crossJoin(n(good, "good")).crossJoin(n(unique, "unique")).crossJoin(n(kept, "kept"))  # single rows
    return row.select("total", (F.col("total") - F.col("good")).alias("malformed"), (F.col("good") - F.col("unique")).alias("exact_duplicates"), (F.col("unique") - F.col("kept")).alias("near_duplicates"), "kept")


def deal(sizes: list[int], shares: tuple[float, ...] = (0.7, 0.15), seed: int = 42) -> list[int]:
    """The split of each group: groups in a seeded order go to the first split whose share of all rows still has room for them.

    The last split takes what fits nowhere; each of the others takes its first group whatever its size.
    """
    total, taken, out = sum(sizes), [0] * len(shares), [len(shares)] * len(sizes)
    empty = [True] * len(shares)
    for i in np.random.RandomState(seed).permutation(len(sizes)).tolist():
        for k, share in enumerate(shares):
            if taken[k] + sizes[i] <= total * share or empty[k]:
                taken[k], empty[k], out[i] = taken[k] + sizes[i], False, k
                break
    return out


def grouped_split(df: DataFrame, group: str = "source", order: str = "doc_id", train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split: whole groups, in a seeded order, dealt greedily (a later small group may still fit).

    Groups are numbered by first appearance on the executors; only their sizes, one number for each, come to the driver,
    and only split numbers go back.
    """
    found = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min(order).alias("_at")).withColumns({"_o": F.struct(F.col("_at").isNull(), "_at", "_group"), "_one": F.lit(1)})
    places = stage(ranks.before(found, "_o", "_one", name="_place").select("_group", "_n", "_place"))
    sizes = places.orderBy("_place").select("_n").toPandas()["_n"].tolist()
    names = ("train", "val", "test")
    dealt = df.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(deal(sizes, (train, val), seed))], "_place long, split string")
    table = places.join(dealt, "_place").select("_group", "split")
    return df.join(table, df[group].eqNullSafe(table["_group"]), "left").drop("_group")


def leaks(df: DataFrame, group: str = "source") -> DataFrame:
    """Groups that occur in more than one split: none, if the split holds."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("splits")).where("splits > 1")
