"""Ranked lexical search: variable-block-max WAND over shards of the documents.

An index is a table with a row for each shard, a run of documents that one task has read. A shard holds the posting
list of each term, in the order of doc_id, with integer impacts. Dynamic programming cuts every list in blocks of
varying length so that the sum over all postings of the block's greatest impact minus their own, plus a fixed cost for
each block, is least. A search adds the query's weighted block maxima up to a bound for every document of the shard (a
sparse list counts at its own documents, where WAND's cursors would stop, a dense one over the range of each block) and
reads only blocks that hold a document whose bound can still enter the result: first the documents of the highest
bounds, which raise the threshold, then ever more until no bound reaches it. That is exact, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import tokens
from .shared import mapped, rows_of, staged, struct, unstage

TOP = 10
#: Documents and postings from which a shard is full.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Longest block, and what a block costs in mean impacts of its list.
LONGEST, BLOCK_COST = 64, 4.0
#: Lists with at least this share of the shard's documents are dense.
DENSE = 0.125
#: Items and characters of their texts that a search takes at a time; more go in parts.
PART_ITEMS, PART_CHARS = 20_000, 1 << 24

FORWARD = struct(doc_id=T.LongType(), size=T.LongType(), terms=T.ArrayType(T.LongType(), False), counts=T.ArrayType(T.IntegerType(), False))
INDEX = struct(
    doc_ids=T.ArrayType(T.LongType()),
    terms=T.ArrayType(T.LongType(), False),
    list_starts=T.ArrayType(T.IntegerType(), False),
    ords=T.ArrayType(T.IntegerType(), False),
    impacts=T.ArrayType(T.IntegerType(), False),
    block_lists=T.ArrayType(T.IntegerType(), False),
    block_starts=T.ArrayType(T.IntegerType(), False),
)
FOUND = struct(item=T.IntegerType(), doc_id=T.LongType(), score=T.LongType())


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    sizes = end - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes[:-1])]), sizes) + np.arange(sizes.sum()) if len(begin) else np.zeros(0, np.int64)


# ---- postings of each document


def forward(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, number of terms with repeats, and fingerprints and counts of its distinct terms (of those in ``only``)."""
    shipped = None if only is None else docs.sparkSession.sparkContext.broadcast(np.unique(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, prints, sizes in tokens.fingerprints(batch.column("text")):
                doc, term = np.repeat(np.arange(len(sizes)), sizes), prints.view(np.int64)
                if shipped is not None:
                    known = shipped.value
                    place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
                    mine = known[place] == term if len(known) else np.zeros(len(term), bool)
                    doc, term = doc[mine], term[mine]
                order = np.lexsort((term, doc))
                doc, term = doc[order], term[order]
                begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, np.int64)
                cuts = pa.array(np.searchsorted(doc[begin], np.arange(len(sizes) + 1)).astype(np.int32))
                counts = np.diff(np.append(begin, len(doc))).astype(np.int32)
                ids = batch.column("doc_id").slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(term[begin])), pa.ListArray.from_arrays(cuts, pa.array(counts))], names=FORWARD.names)

    return mapped(rows_of(docs, doc_id="long", text="string"), run, FORWARD)


# ---- shards


def cut_blocks(impacts: np.ndarray, starts: np.ndarray, longest: int = LONGEST, cost: float = BLOCK_COST) -> tuple[np.ndarray, np.ndarray]:
    """First postings of the blocks, and the number of the first block of each list (one more than lists, both).

    best[i] = min over l of best[i - l] + l * max(impacts[i - l : i]) + cost * mean impact. All lists go in step.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    size, begin = sizes[order], starts[:-1][order]
    mean = np.add.reduceat(impacts.astype(np.float64), starts[:-1])[order] / size if len(size) else np.zeros(0)
    fixed, lengths = cost * mean, np.arange(1, longest + 1, dtype=np.float64)
    before = np.full((len(size), longest), np.inf)  # best of 1, 2, ... postings earlier
    if len(size):
        before[:, 0] = 0
    most, taken = np.zeros((len(size), longest)), np.zeros(len(impacts), np.int16)
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for i, n in enumerate(active.tolist()):
        own = impacts[begin[:n] + i].astype(np.float64)
        m, b = most[:n], before[:n]
        m[:, 1:] = m[:, :-1]
        m[:, 0] = 0
        np.maximum(m, own[:, None], out=m)
        total = m * lengths + b
        l = total.argmin(1)
        taken[begin[:n] + i] = l + 1
        best = total[np.arange(n), l] + fixed[:n]
        b[:, 1:] = b[:, :-1]
        b[:, 0] = best
    cuts, at, low = [], starts[1:].copy(), starts[:-1]
    while True:  # from the ends of all lists back to their beginnings
        live = at > low
        if not live.any():
            break
        at, low = at[live], low[live]
        at = at - taken[at - 1]
        cuts.append(at)
    block_starts = np.sort(np.concatenate([*cuts, starts[-1:]])) if cuts else starts[-1:]
    return block_starts, np.searchsorted(block_starts, starts)


def shard_of(ids: list, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, held: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row of an index. held: distinct terms of each document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    cuts = np.concatenate([[0], np.cumsum(held)])
    order = np.array(order, np.int64)
    at = ranges(cuts[order], cuts[order + 1])
    terms, counts, ords = terms[at], counts[at].astype(np.int64), np.repeat(np.arange(len(order)), held[order])
    m = 100 - 90 + (90 * sizes[order] * n_docs) // max(n_terms, 1)
    impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * m[ords])
    by = np.argsort(terms, kind="stable")
    terms, ords, impacts = terms[by], ords[by], impacts[by]
    begin = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    starts = np.append(begin, len(terms))
    block_starts, block_lists = cut_blocks(impacts, starts)
    whole = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [whole([ids[i] for i in order], pa.int64()), whole(terms[begin], pa.int64()), *(whole(x.astype(np.int32), pa.int32()) for x in (starts, ords, impacts, block_lists, block_starts))], names=INDEX.names
    )


def index(postings: DataFrame, n_docs: int, n_terms: int, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """A row for each shard of the rows of ``forward``. A task reads its own part and makes as many shards as that fills; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            held = table.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            return shard_of(table.column("doc_id").to_pylist(), table.column("size").to_numpy(), flat("terms"), flat("counts"), held, n_docs, n_terms)

        docs = filled = 0
        for batch in batches:
            kept.append(batch)
            docs, filled = docs + batch.num_rows, filled + len(batch.column("terms").flatten())
            if docs >= shard_docs or filled >= shard_postings:
                yield flush()
                docs = filled = 0
        if docs:
            yield flush()

    return mapped(postings.where("size > 0"), run, INDEX)


# ---- search


@dataclass
class Shard:
    """The arrays of one row of an index, with what blocks bound."""

    ids: list
    terms: np.ndarray
    ords: np.ndarray
    impacts: np.ndarray
    block_lists: np.ndarray
    block_starts: np.ndarray

    def __post_init__(self) -> None:
        own = self.block_starts[:-1]
        self.most = np.maximum.reduceat(self.impacts, own) if len(own) else np.zeros(0, np.int64)
        self.first, self.last = self.ords[own], self.ords[self.block_starts[1:] - 1]
        self.read = 0  # postings scored by searches so far

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = TOP, least: int = 1) -> list[tuple[int, int]]:
        """(score, place) of the k best of the documents that score ``least`` or more, ties by place."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, w = at[there], weights[there]
        if not len(at):
            return []
        begin, end, n = self.block_lists[at], self.block_lists[at + 1], len(self.ids)
        dense = np.repeat(self.block_starts[end] - self.block_starts[begin] >= DENSE * n, end - begin)
        blocks, w = ranges(begin, end), np.repeat(w, end - begin)
        first, last, most = self.first[blocks], self.last[blocks], w * self.most[blocks]
        bound = np.cumsum(np.bincount(first[dense], most[dense], n + 1) - np.bincount(last[dense] + 1, most[dense], n + 1))[:n].astype(np.float64)
        begin, end = self.block_starts[blocks[~dense]], self.block_starts[blocks[~dense] + 1]
        bound += np.bincount(self.ords[ranges(begin, end)], np.repeat(most[~dense], end - begin), n)
        scores, size = np.zeros(n), 64
        best = np.zeros(0, np.int64)
        while True:
            some = np.flatnonzero(bound >= least)
            if not len(some):
                break
            if len(some) > size:
                some = some[np.argpartition(-bound[some], size)[:size]]
            size *= 8
            wanted = np.zeros(n, bool)
            wanted[some] = True
            before = np.concatenate([[0], np.cumsum(wanted)])
            live = before[last + 1] > before[first]
            begin, end = self.block_starts[blocks[live]], self.block_starts[blocks[live] + 1]
            post = ranges(begin, end)
            self.read += len(post)
            place = self.ords[post]
            mine = wanted[place]
            scores += np.bincount(place[mine], (np.repeat(w[live], end - begin) * self.impacts[post])[mine], n)
            bound[some] = -1
            best = np.concatenate([best, some[scores[some] >= least]])
            best = best[np.lexsort((best, -scores[best]))][:k]
            if len(best) == k:
                least = max(least, int(scores[best[-1]]))
        return [(int(scores[i]), int(i)) for i in best]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for name in INDEX.names[1:]}
            yield Shard(batch.column("doc_ids")[i].as_py(), own["terms"], own["ords"], own["impacts"], own["block_lists"], own["block_starts"])


def search(found_in: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int = TOP) -> DataFrame:
    """item (number of the query), doc_id, score and rank of the k best documents of each query (fingerprints, weights)."""
    shipped = found_in.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for shard in shards(batches):
            for item, (terms, weights) in enumerate(shipped.value):
                own = best.get(item, [])
                least = -own[-1][0] if len(own) == k else 1  # what earlier shards of this task have
                if more := shard.search(terms, weights, k, least):
                    best[item] = sorted(own + [(-score, shard.ids[i] is None, shard.ids[i] or 0) for score, i in more])[:k]
        flat = [(item, None if none else doc, -score) for item, own in best.items() for score, none, doc in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*flat), (pa.int32(), pa.int64(), pa.int64()))], names=FOUND.names)

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return mapped(found_in, run, FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def terms_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct fingerprints of each text's terms."""
    out = []
    for _, prints, sizes in tokens.fingerprints(pa.array(texts, pa.string())):
        out += [np.unique(x.view(np.int64)) for x in np.split(prints, np.cumsum(sizes)[:-1])]
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, part_items: int = PART_ITEMS, part_chars: int = PART_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of items.

    The index holds every document, with the terms that some item has; its statistics count all terms of all documents.
    Null and empty texts have no term: such documents are never found, such items find nothing. Documents without an id
    rank after others of the same score. Rows that repeat, of documents or items, count each; further columns are not
    read; of an empty table nothing is found. Texts are read whole. Terms are told apart by 64-bit fingerprints.
    """
    asked = rows_of(items, item_id="long", text="string").where("text is not null")
    n_items, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n_items // part_items), -(-chars // part_chars))
    out = []
    for part in range(parts):
        own = sorted(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))  # bounded by the part
        terms = terms_of([r.text for r in own])
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]))
        postings = staged(forward(docs, known), "postings")
        n_docs, n_terms = postings.agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
        table = staged(index(postings, n_docs, n_terms), "index")
        unstage(postings)
        lists = table.select(F.explode(F.expr("transform(terms, (t, i) -> named_struct('term', t, 'held', list_starts[i + 1] - list_starts[i]))")).alias("x"))
        df = {r.term: r.df for r in lists.groupBy("x.term").agg(F.sum("x.held").alias("df")).collect()}  # at most the items' terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in known.tolist()}
        queries = [(t, np.array([weight[x] for x in t.tolist()], np.int64)) for t in terms]
        ids = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "item int, item_id long")
        found = search(table, queries, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out.append(staged(found, "found"))  # k rows of each item
        unstage(table)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op13_wand(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
totals as (select cast(count(*) filter (where len(terms) > 0) as bigint) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d),
asked as (select row_number() over () as item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms from benchmark),
wanted as (select item, item_id, unnest(terms) as term from asked),
tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from d) group by r, doc_id, n, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by term),
scored as (
  select item, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from wanted join tf using (term) join weights using (term), totals group by item, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id asc nulls last, r) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
