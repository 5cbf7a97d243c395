"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in segments of 23, 23 and 18 bits (the last a shortened word). The perfect binary Golay
code puts each 23-bit word within 3 bits of one code word, whose 12-bit index is the word's decoding. If two
fingerprints differ in at most 4 bits, the two segments with the fewest errors have at most 2 together (pigeonhole), so
some pair of segments has a word at distance 1 or less from both. Decoding a pair of segments and its one-bit
neighbours therefore gives both fingerprints a common key: about eleven keys for each of the three pairs. Rows that
share a key are verified by their Hamming distance. Keys that many fingerprints share are cut in blocks and compared
block by block in separate tasks; a group gives a spanning forest, never all its pairs. Components follow by
alternating large-star and small-star steps over staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, mapped, rows_of, staged, struct, unstage

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (lowest bit, width)
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HOT_KEY = 4096  # fingerprints of a key from which it is compared in blocks of that size


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; 0 for a text without words."""
    parts = text.lower().split()  # on bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    stop = start + size - 1
    begin, end = start[:n].tolist(), stop[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(begin[lo : lo + 65536], end[lo : lo + 65536])], repeat(seed)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@lru_cache(1)
def _code() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a 23-bit word, and the error word of each syndrome."""

    def syndrome(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    single = [syndrome(1 << b) for b in range(23)]
    tables = []
    for byte in range(3):
        t = np.zeros(256, np.int64)
        for b in range(min(8, 23 - 8 * byte)):
            t[(np.arange(256) >> b & 1) == 1] ^= single[8 * byte + b]
        tables.append(t)
    error = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                word = len({a, b, c})
                bits = {a, b, c}
                if word == 2 and a != b:
                    continue
                error[np.bitwise_xor.reduce([single[i] for i in bits])] = sum(1 << i for i in bits)
    return tables, error


def decode(x: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest code word of each 23-bit word."""
    tables, error = _code()
    s = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16]
    return (x ^ error[s]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct keys of each fingerprint (uint64)."""
    seg = [((fp >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in SEGMENTS]
    near = [decode(s[:, None] ^ np.concatenate([[0], 1 << np.arange(w)])[None, :]) for s, (_, w) in zip(seg, SEGMENTS)]
    cols = []
    for k, (i, j) in enumerate(PAIRS):
        cols += [(k << 24) + (near[i] << 12) + near[j][:, :1], (k << 24) + (near[i][:, :1] << 12) + near[j][:, 1:]]
    keys = np.sort(np.concatenate(cols, axis=1), axis=1)
    new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return np.nonzero(new)[0], keys[new]


def _forest(a: np.ndarray, b: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over a (and b, where only links between a and b count): each point to one before it."""
    out = []
    if b is None:
        rest = a
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                p = front.pop()
                hit = np.bitwise_count(rest ^ p) <= most
                if hit.any():
                    got = rest[hit]
                    out += zip(repeat(int(p)), got.tolist())
                    front += list(got)
                    rest = rest[~hit]
    else:
        left, right = a, b
        while len(left) and len(right):
            front, left = [(left[0], True)], left[1:]
            while front:
                p, of_left = front.pop()
                rest = right if of_left else left
                hit = np.bitwise_count(rest ^ p) <= most
                if hit.any():
                    got = rest[hit]
                    out += zip(repeat(int(p)), got.tolist())
                    front += [(x, not of_left) for x in got]
                    if of_left:
                        right = right[~hit]
                    else:
                        left = left[~hit]
    return out


def group_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int) -> set[tuple[int, int]]:
    """Links inside sorted runs of equal keys; side 0 rows among themselves, sides 1 and 2 between each other."""
    cut = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
    size = np.diff(cut)
    out: set[tuple[int, int]] = set()
    small = np.repeat(size <= 32, size)
    for step in range(1, int(min(size.max(initial=0), 32))):
        same = (key[step:] == key[:-step]) & small[step:]
        hit = np.nonzero(same)[0]
        near = hit[(np.bitwise_count(fp[hit] ^ fp[hit + step]) <= most) & ((side[hit] == 0) | (side[hit] != side[hit + step]))]
        out.update(zip(fp[near].tolist(), fp[near + step].tolist()))
    for g in np.nonzero(size > 32)[0]:
        rows, kind = fp[cut[g] : cut[g + 1]], side[cut[g] : cut[g + 1]]
        out.update(_forest(rows, None, most) if not kind.any() else _forest(rows[kind == 1], rows[kind == 2], most))
    return out


LONG = T.LongType()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long). Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t or b"") for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return mapped(rows_of(docs, doc_id="long", text="binary"), run, struct(doc_id=LONG, fp=LONG))


def near_links(distinct: DataFrame, most: int = 4, hot: int = HOT_KEY) -> DataFrame:
    """Links (a > b) between distinct fingerprints: a spanning forest of each key's links, which keeps every component."""
    if most > 4:
        raise ValueError("the keys cover up to 4 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 8192):
                row, key = keys_of(fp[lo : lo + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[lo : lo + 8192][row].view(np.int64))], names=["key", "fp"])

    keyed = distinct.mapInArrow(emit, struct(key=LONG, fp=LONG))
    # A hot key is cut in blocks by a hash; each pair of blocks is a group of its own.
    crowded = keyed.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks"))
    blocks, own = F.coalesce("blocks", F.lit(1)), F.col("own")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = (
        keyed.join(crowded, "key", "left")
        .select("key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"), other)
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(own == F.col("other"), 0).when(own < F.col("other"), 1).otherwise(2).alias("side"), "fp")
    )
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            key = np.cumsum(np.concatenate([[0], np.any(np.diff(rows[:, :3], axis=0) != 0, axis=1)]))
            got = group_links(key, rows[:, 3], rows[:, 4].copy().view(np.uint64), most)
            pairs = np.array([(max(p), min(p)) for p in got], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "i", "j", "side", "fp")], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            edge = np.nonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))[0]
            if len(edge):  # the last group may go on in the next batch
                done = np.concatenate(held)
                keep = len(rows) - edge[-1] - 1
                held = [done[len(done) - keep :]]
                yield flush(done[: len(done) - keep])
        if held:
            yield flush(np.concatenate(held))

    return sorted_rows.mapInArrow(link, struct(a=LONG, b=LONG)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every linked node but the roots, by alternating stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        grown = staged(small.distinct(), "edges")
        now = grown.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(edges)
        edges = grown
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of each document.

    Null texts count as empty (fingerprint zero); rows without a doc_id take part, and their component_id is null
    only if no row of their component has one. Repeated rows stay. An empty table gives an empty result.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(fps.select("fp").distinct(), most))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "classes")
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(group, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
