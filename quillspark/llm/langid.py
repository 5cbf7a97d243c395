"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes of orders 0 to ``max_order``. A symbol's probability under a context is
count / (total + distinct) and the escape's is distinct / (total + distinct) (method C), with full exclusion: after an
escape, symbols of the longer context no longer take probability from the shorter one. Below order 0 the bytes that
were never seen share the rest evenly. Statistics are frozen after fitting, so a text's code length is a sum of fixed
costs. All languages share one automaton whose states are the kept contexts (the longest suffix of the bytes so far),
so that one table look-up per byte gives the exact cost in every language. Long texts are cut in chunks that first
replay ``max_order`` bytes, after which the state is the same as in one pass: whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import documents, mapped, rows_of, struct

UNDETERMINED = "und"
CHUNK = 256
#: Labels up to which their counts are broadcast.
BROADCAST_LABELS = 10_000


@dataclass
class ByteModel:
    """Frozen statistics: symbol of each byte, next state and costs in bits by (state, symbol), and languages."""

    languages: list[str]
    symbol: np.ndarray  # 256 -> symbol; bytes never seen share the last symbol but one, padding is the last
    follow: np.ndarray  # state * symbols + symbol -> state
    cost: np.ndarray  # (state * symbols + symbol, language) -> bits
    order: int

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 2


def _grams(codes: np.ndarray, starts: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as numbers in the given base, that stay inside a text, and their counts."""
    value, inside = np.zeros(len(codes) - n + 1, np.int64), np.ones(len(codes) - n + 1, bool)
    for j in range(n):
        part = codes[j : len(codes) - n + 1 + j]
        value = value * base + part
        inside &= part < base
    return np.unique(value[inside], return_counts=True)


def fit_bytes(texts: list[str], labels: list[str], max_order: int = 3, min_count: int = 16) -> ByteModel:
    """Context trees of every language. A context is kept where some language has seen it ``min_count`` times."""
    languages = sorted(set(labels))
    blobs = {k: b"\0".join(t.encode("utf-8", "replace").replace(b"\0", b" ") for t, k2 in zip(texts, labels) if k2 == k) for k in languages}
    seen = np.zeros(256, bool)
    for b in blobs.values():
        seen[np.unique(np.frombuffer(b, np.uint8))] = True
    seen[0] = False
    known = int(seen.sum())
    base, wide, absent = known + 1, known + 2, 256 - known
    symbol = np.full(256, known, np.int64)
    symbol[seen] = np.arange(known)
    levels: list[dict] = []
    for n in range(1, max_order + 2):
        found = []
        for k in languages:
            raw = np.frombuffer(blobs[k], np.uint8)
            codes = np.where(raw == 0, base, symbol[raw])
            found.append(_grams(codes, None, n, base) if len(codes) >= n else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        levels.append({"found": found})
    # States by level: contexts as numbers, kept if frequent in any language and their suffix is kept.
    contexts = [np.zeros(1, np.int64)]
    for n in range(1, max_order + 1):
        often = np.unique(np.concatenate([v[c >= min_count] for v, c in levels[n - 1]["found"]]))
        suffix = often % base ** (n - 1)
        contexts.append(often[np.isin(suffix, contexts[n - 1])])
    first = np.cumsum([0, *map(len, contexts)])
    cost = np.zeros((first[-1], wide, len(languages)), np.float32)
    follow = np.zeros((first[-1], wide), np.int32)
    for n, own in enumerate(contexts):
        up = first[n - 1] + np.searchsorted(contexts[n - 1], own % base ** (n - 1)) if n else None
        here = slice(first[n], first[n] + len(own))
        for i in range(len(languages)):
            value, count = levels[n]["found"][i]
            at = np.searchsorted(own, value // base)
            ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == value // base)
            c = np.zeros((len(own), base), np.float64)
            c[at[ok], value[ok] % base] = count[ok]
            levels[n].setdefault("c", []).append(c)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            if n == 0:  # the bytes never seen in any language are spread evenly below order 0
                rest = known - kinds + absent
                lower = np.full((1, base), np.log2(max(int(rest[0, 0]), 1)))
            else:
                above, a_total, a_kinds = levels[n - 1]["c"][i][up - first[n - 1]], None, None
                a_total = above.sum(1, keepdims=True) - np.where(c > 0, above, 0).sum(1, keepdims=True)
                a_kinds = (above > 0).sum(1, keepdims=True) - kinds
                whole = a_total + a_kinds
                full_t, full_k = above.sum(1, keepdims=True), (above > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape_above = np.where(full_k > 0, np.log2((full_t + full_k) / np.maximum(full_k, 1)), 0)
                    escape_here = np.where(a_kinds > 0, np.log2(whole / np.maximum(a_kinds, 1)), 0)
                    direct = np.log2(np.maximum(whole, 1) / np.maximum(above, 1))
                inherited = cost[up, :base, i]
                lower = np.where(above > 0, direct, inherited - escape_above + escape_here)
                lower = np.where(total > 0, lower, inherited)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0)
                own_cost = np.log2(np.maximum(total + kinds, 1) / np.maximum(c, 1))
            cost[here, :base, i] = np.where(c > 0, own_cost, lower + escape)
        # The next state is the longest kept suffix of context + symbol.
        grown = own[:, None] * base + np.arange(base)[None, :]
        state = np.zeros((len(own), base), np.int64)
        for m in range(min(n + 1, max_order), 0, -1):
            tail = grown % base**m
            pos = np.minimum(np.searchsorted(contexts[m], tail), max(len(contexts[m]) - 1, 0))
            hit = (contexts[m][pos] == tail) if len(contexts[m]) else np.zeros_like(tail, bool)
            state = np.where((state == 0) & hit, first[m] + pos, state)
        follow[here, :base] = state
    return ByteModel(languages, symbol, follow.reshape(-1), cost.reshape(-1, len(languages)), max_order)


def code_lengths(model: ByteModel, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language (rows as texts)."""
    out = np.zeros((len(texts), len(model.languages)))
    d, wide = model.order, model.symbols
    pad = wide - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return out
    codes = np.concatenate([np.full(d, pad, np.uint8), *(x for t in texts for x in (model.symbol[np.frombuffer(t, np.uint8)].astype(np.uint8), np.full(d, pad, np.uint8)))])
    begin = d + np.cumsum(np.concatenate([[0], sizes[:-1] + d]))
    pieces = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), pieces)
    start = begin[owner] + CHUNK * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(start + CHUNK, (begin + sizes)[owner])
    order = np.argsort(start - stop, kind="stable")  # long chunks first, so that a group ends together
    for lo in range(0, len(order), 8192):
        own = order[lo : lo + 8192]
        s, e = start[own], stop[own]
        longest = int((e - s).max())
        state, bits = np.zeros(len(own), np.int64), np.zeros((len(own), out.shape[1]), np.float64)
        for j in range(-d, longest):
            at = s + j
            sym = np.where(at < e, codes[np.minimum(at, len(codes) - 1)], pad)
            index = state * wide + sym
            state = model.follow[index].astype(np.int64)
            if j >= 0:
                bits += model.cost[index]
        np.add.at(out, owner[own], bits)
    return out


def training_rows(docs: DataFrame, per_language: int = 400, longest: int = 65536, most: int = 20_000) -> DataFrame:
    """A bounded sample of labelled rows: ``per_language`` of each label at most, drawn by a hash of doc_id and text.

    Only documents outside the held-out quarter are drawn, and of rows alike one; of a text longer than ``longest``
    characters a stretch of that length, from a place that the hash gives. With many labels each has fewer rows, so that
    all have at most ``most``, or one each. The bounds cover fitting only; every document is scored, whole.
    """
    rows = rows_of(docs, doc_id="long", text="string", lang="string").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    rows = rows.withColumn("drawn", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("drawn", 0.05).alias("kinds"))
    n_labels = kinds.count()
    own = max(1, min(per_language, most // max(n_labels, 1)))
    # Twice as many as wanted pass the hash, all of a label with few; what is left is small enough to rank.
    counted = rows.join(F.broadcast(kinds) if n_labels <= BROADCAST_LABELS else kinds, "lang")
    few = counted.where(F.col("drawn") / F.lit(float(1 << 62)) * F.col("kinds") < 2.0 * own + 50)
    at = F.pmod("drawn", F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    stretch = F.when(F.length("text") > longest, F.substr("text", at.cast("int"), F.lit(longest))).otherwise(F.col("text"))
    alike = few.select("lang", "drawn", stretch.alias("text")).groupBy("lang", "drawn").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn"))
    return alike.withColumn("place", place).where(F.col("place") <= own).select("text", "lang")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400, max_order: int = 3, min_count: int = 16) -> ByteModel | None:
    rows = training_rows(docs, per_language).orderBy("lang", "text").collect()  # at most per_language rows of each label, of at most longest characters
    return fit_bytes([r.text for r in rows], [r.lang for r in rows], max_order, min_count) if rows else None


OUTPUT = struct(doc_id=T.LongType(), held_out=T.BooleanType(), lang_pred=T.StringType(), score=T.DoubleType(), bits_per_byte=T.DoubleType())


def identify(docs: DataFrame, model: ByteModel | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte.

    score is the posterior of the predicted language under equal priors; bits_per_byte its code length over the size.
    Null texts and texts without a letter give ``und``, score 0 and null bits. Ties go to the first language by name.
    Long texts are scored whole. Repeated rows stay, further columns go; an empty table gives an empty result.
    """
    ready = rows_of(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("text"))
    if model is None:
        return ready.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array(model.languages, object)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            bits = np.concatenate([code_lengths(model, [t or b"" for t in texts[i : i + 1024]]) for i in range(0, len(texts), 1024)]) if texts else np.zeros((0, len(names)))
            best = bits.argmin(1)
            lowest = bits[np.arange(len(bits)), best]
            score = 1 / np.exp2(np.maximum(lowest[:, None] - bits, -1000)).sum(1)
            some = [t is not None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x if ok else UNDETERMINED for x, ok in zip(names[best], some)], pa.string()), pa.array(np.where(some, score, 0.0)), pa.array([b / len(t) if t else None for b, t in zip(lowest.tolist(), texts)], pa.float64())], names=OUTPUT.names)

    return mapped(ready, run, OUTPUT)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
