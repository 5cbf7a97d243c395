"""Substring deduplication by hashing of lines and paragraphs.

Every line and every paragraph (lines up to a blank one) of at least ``min_chars`` characters is normalised (lower case,
single spaces) and digested. For passages inside lines a text is also cut in units at line ends, after sentence ends and
where a capitalised word follows a lower-case one, so that a passage is cut alike wherever it stands; from every unit,
and up to every unit, the shortest run of whole units of at least ``min_words`` words, taken over line ends, is digested
too. Digests are grouped over all documents; the occurrence of the least (doc_id, start) stays and the others go.
Offsets are code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, mapped, rows_of, staged

WORD = re.compile(r"\S+")
MIN_WORDS = 25
#: Characters of a normalised line or paragraph below which it isn't hashed on its own.
MIN_CHARS = 12
#: Digests, commonest first, whose first occurrence is broadcast; the bound of that broadcast in rows.
HEAVY = 1000


def units(text: str) -> tuple[list[int], list[int], list[str], list[int], list[int]]:
    """Start of each unit, the place of its first word, the words in lower case, and the units that begin lines and paragraphs."""
    starts: list[int] = []
    first: list[int] = []
    words: list[str] = []
    lines: list[int] = []
    paragraphs: list[int] = []
    line_at, blank = 0, True
    for line in text.split("\n"):
        own = line.split()
        if own:
            lines.append(len(starts))
            if blank:
                paragraphs.append(len(starts))
            # A unit begins the line, follows a sentence's end, or is a capitalised word after a lower-case letter or comma.
            cuts = [0]
            cuts += [i for i, (a, b) in enumerate(pairwise(own), 1) if a[-1] in ".!?" or b[0].isupper() and (a[-1].islower() or a[-1] == ",")]
            sizes = list(map(len, own))
            if sum(sizes) + len(own) - 1 == len(line):  # single spaces, so that lengths give the places
                places = [0, *accumulate(n + 1 for n in sizes[:-1])]
            else:
                places = [m.start() for m in WORD.finditer(line)]
            starts += [line_at + places[i] for i in cuts]
            first += [len(words) + i for i in cuts]
            words += own
        blank = not own
        line_at += len(line) + 1
    return starts, first, " ".join(words).lower().split(" ") if words else words, lines, paragraphs


def runs(text: str, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, int, int]]:
    """(64 and 32 bits of a digest, start, end) of each line, each paragraph, and the shortest runs of enough words from and up to each unit; the end is the next unit's start."""
    starts, first, words, lines, paragraphs = units(text)
    first.append(len(words))
    starts.append(len(text))
    found, n, j = set(), len(first) - 1, 0
    for i in range(n):
        while j < n and first[j] - first[i] < min_words:
            j += 1
        if first[j] - first[i] < min_words:
            break
        found.add((i, j))
    i = 0
    for j in range(1, n + 1):  # and the shortest run that ends at each unit, so that a short last unit isn't left over
        while i + 1 < j and first[j] - first[i + 1] >= min_words:
            i += 1
        if first[j] - first[i] >= min_words:
            found.add((i, j))
    for begins in (lines, paragraphs):
        for i, j in pairwise([*begins, n]):
            if sum(map(len, words[first[i] : first[j]])) + first[j] - first[i] - 1 >= min_chars:
                found.add((i, j))
    for i, j in sorted(found):
        d = xxhash.xxh3_128_intdigest(" ".join(words[first[i] : first[j]]).encode("utf-8", "replace"))
        yield (d >> 64) - (1 << 63), (d & (1 << 32) - 1) - (1 << 31), starts[i], starts[j]


def _keyed(docs: DataFrame) -> DataFrame:
    return rows_of(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "doc_id", "text")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, th (what names a document), start, end of every occurrence but the earliest of each repeated run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["k", "th", "h1", "h2", "start", "end"]
        for batch in batches:
            out: list[tuple] = []
            for k, th, text in zip(batch.column("k").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist()):
                out += [(k, th, *r) for r in runs(text or "", min_words)]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    found = mapped(_keyed(docs).select("k", "th", "text"), run, "k bigint, th bigint, h1 bigint, h2 int, start int, end int")
    grouped = found.groupBy("h1", "h2").agg(F.min(F.struct("k", "start", "th", "end")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = staged(grouped, "repeated")  # repeated digests alone; the runs themselves are cut again rather than written
    # The commonest digests come by broadcast, so that no digest left to the shuffle holds more than 1/HEAVY of all runs.
    heavy = first.orderBy(F.desc("n"), "h1", "h2").limit(HEAVY).select("h1", "h2", F.col("first").alias("common"))
    dealt = found.join(F.broadcast(heavy), ["h1", "h2"], "left")
    # A run that has its answer is dealt by its place; whatever it might meet there is ignored.
    dealt = dealt.withColumn("h1", F.when(F.col("common").isNull(), F.col("h1")).otherwise(F.xxhash64("k", "th", "start", "end")))
    met = dealt.join(first.select("h1", "h2", "first"), ["h1", "h2"], "left").withColumn("first", F.coalesce("common", "first")).where("first is not null")
    own = (F.col("k") == F.col("first.k")) & (F.col("th") == F.col("first.th"))
    # An occurrence that overlaps the first one of its own document goes only from where that ends.
    start = F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start"))
    return met.where(~(own & (F.col("start") == F.col("first.start")))).select("k", "th", start.alias("start"), "end").where("start < end")


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without its repeated passages, removed: array of struct(start, end) in the text as it was.

    Null texts stay null and empty ones empty. Rows alike in doc_id and text count as one document and all stay;
    rows without a doc_id rank first, by their texts' hashes. Texts of under MIN_CHARS characters are never touched.
    Long texts are cut whole; further columns go; an empty table gives an empty result.
    """
    docs = _keyed(docs)
    spans = repeated_spans(docs.select("doc_id", "text"), min_words).groupBy("k", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # rows alike give each span once

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                if merged:
                    at, kept = 0, []
                    for a, b in merged:
                        kept.append(text[at:a])
                        at = b
                    text = "".join(kept) + text[at:]
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "text", "removed"])

    return mapped(docs.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans"), cut, "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint>>")


def op4_substring(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.expr("array_join(transform(removed, r -> concat_ws(':', r.start, r.end)), ',')").alias("spans"))
