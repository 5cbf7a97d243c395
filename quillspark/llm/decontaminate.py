"""Benchmark decontamination by latent semantic retrieval.

Documents become sequences of hashed words. Passages of 64 words give document frequencies over the whole corpus, and
a distributed randomised SVD of the TF-IDF passages: each task adds A^T (A Omega) of its passages, the sums (of fixed
size, features x rank) meet on the driver, and a Nystrom step gives singular values and vectors. Windows of every
document, as long as the benchmark items' length classes and an eighth of that apart, are compared with the items by
cosine in the whitened latent space. Windows over the threshold, and all that hold enough of an item's words to be a
literal hit, are verified by the longest common subsequence of words with the item: a copy has most of the item's words
in order; a paraphrase has fewer, but those of the item's answer (its last sentence) in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, rows_of, staged

FEATURES = 1 << 14
PASSAGE = 64
RANK, OVERSAMPLE = 40, 8
LENGTHS = (8, 16, 24, 32, 48, 64, 96, 128)
COSINE = 0.35
BLOCK = 192
GROUP = 256
KEPT = 32 << 20
#: Shares of an item's words in order; from LITERAL on an item is sought whatever its cosine.
COPY, LITERAL, PARAPHRASE, ANSWER = 0.7, 0.6, 0.35, 0.8
#: ASCII letters in lower case; other ASCII characters but digits separate words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def hashed_words(text: bytes) -> np.ndarray:
    """32-bit hash of each word, in order."""
    words = text.translate(FOLD).split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def _terms(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.uint16)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id and words: 16-bit word hashes of the whole text. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashed_words(t or b"").astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "words"])

    return mapped(rows_of(docs, doc_id="long", text="binary"), run, "doc_id bigint, words binary")


def _passages(batch: pa.RecordBatch, size: int = 1 << 14) -> Iterator[np.ndarray]:
    """Blocks (passages, PASSAGE) of feature numbers; FEATURES pads a document's last passage."""
    held, n = [], 0
    for blob in batch.column("words").to_pylist():
        t = _terms(blob) & (FEATURES - 1)
        for lo in range(0, len(t), PASSAGE * size):
            part = t[lo : lo + PASSAGE * size]
            short = -len(part) % PASSAGE
            held.append(np.concatenate([part, np.full(short, FEATURES, np.uint16)]) if short else part)
            n += len(held[-1])
            if n >= PASSAGE * size:
                yield np.concatenate(held).reshape(-1, PASSAGE)
                held, n = [], 0
    if held:
        yield np.concatenate(held).reshape(-1, PASSAGE)


def frequencies(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Passages with each feature, its occurrences, and the number of passages: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, n = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for block in _passages(batch, 1 << 12):
                block = np.sort(block, axis=1)
                first = np.concatenate([np.ones((len(block), 1), bool), block[:, 1:] != block[:, :-1]], axis=1)
                df += np.bincount(block[first], minlength=FEATURES + 1)
                cf += np.bincount(block.ravel(), minlength=FEATURES + 1)
                n += len(block)
        df[FEATURES] = n
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(cf[some])], names=["term", "df", "cf"])

    total = words.select("words").mapInArrow(run, "term bigint, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    df, cf = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for r in total.collect():  # FEATURES + 1 rows at most
        df[r.term], cf[r.term] = r.df, r.cf
    return df[:FEATURES], cf[:FEATURES], int(df[FEATURES])


def latent_space(words: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Whitened projection of each feature (idf included), and a passage's mean projection per word."""
    df, cf, n = frequencies(words)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    k = RANK + OVERSAMPLE
    omega = np.random.default_rng(7).standard_normal((FEATURES, k)).astype(np.float32)
    weighted = np.concatenate([omega * idf[:, None], np.zeros((1, k), np.float32)])
    shipped = words.sparkSession.sparkContext.broadcast(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, z, ones = shipped.value, np.zeros((k, FEATURES + 1)), np.ones((1, PASSAGE), np.float32)
        for batch in batches:
            for block in _passages(batch, 1 << 11):
                y = np.concatenate([ones @ table[block[lo : lo + 256].ravel()].reshape(-1, PASSAGE, k) for lo in range(0, len(block), 256)])[:, 0].astype(float)
                flat = block.ravel()
                for i in range(k):
                    z[i] += np.bincount(flat, np.repeat(y[:, i], PASSAGE), FEATURES + 1)
        some = np.nonzero(z[:, :FEATURES].any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(z[i, some]) for i in range(k))], names=["term", *(f"v{i}" for i in range(k))])

    schema = "term bigint, " + ", ".join(f"v{i} double" for i in range(k))
    sums = words.select("words").mapInArrow(run, schema).groupBy("term").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(k)))
    z = np.zeros((FEATURES, k))
    for r in sums.collect():  # FEATURES rows of k numbers at most
        z[r[0]] = r[1:]
    z *= idf[:, None]
    shift = np.sqrt(FEATURES) * 1e-6 * np.linalg.norm(z)
    z += shift * omega
    core = omega.T.astype(float) @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, value.max() * 1e-9)
    v, s, _ = np.linalg.svd(z @ vector / np.sqrt(value), full_matrices=False)
    keep = s > s[0] * 1e-6
    keep[RANK:] = False
    project = (v[:, keep] / s[keep] * idf[:, None]).astype(np.float32)
    return project, (cf @ project / max(cf.sum(), 1)).astype(np.float32)


def common(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence; masks hold the places of each word of the one side."""
    return in_order(list(filter(None, map(masks.get, other))), size)


def in_order(hits: list[int], size: int) -> int:
    """The same, bit-parallel, of the masks of the other side's words; words that the one side lacks change nothing."""
    full = (1 << size) - 1
    v = full
    for m in hits:
        u = v & m
        v = (v + u | v - u) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def together(answer: dict[int, int], size: int, part: list[int]) -> bool:
    """Whether a stretch a quarter longer than the answer has most of its words in order: common words strewn about don't make one."""
    reach = -(-5 * size // 4)
    return any(x in answer and common(answer, size, part[i : i + reach]) >= ANSWER * size for i, x in enumerate(part))


def answer_of(text: str) -> str:
    """An item's answer: its last sentence of three words or more (else its second half)."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").split(".") if len(p.split()) >= 3]
    words = text.split()
    return parts[-1] if len(parts) > 1 else " ".join(words[len(words) // 2 :])


class Items:
    """The benchmark by length class: latent vectors, and what verification needs. Its size must be bounded."""

    def __init__(self, rows: list[tuple[int, str]], project: np.ndarray, mean: np.ndarray):
        self.project, self.mean, self.centred = project, mean, project - mean
        self.rows, by = [], {}
        for item, text in rows:
            words = hashed_words(text.encode("utf-8", "replace")).astype(np.uint16)
            if not len(words):
                continue
            answer = hashed_words(answer_of(text).encode("utf-8", "replace")).astype(np.uint16).tolist()
            v = project[words & (FEATURES - 1)].sum(0) - len(words) * mean
            length = min(LENGTHS, key=lambda x: abs(np.log(x / len(words))))
            if len(words) > 1.25 * LENGTHS[-1]:
                length = len(words)
            by.setdefault(length, []).append(len(self.rows))
            self.rows.append((item, len(words), masks_of(words.tolist()), len(answer), masks_of(answer), v / max(np.linalg.norm(v), 1e-12)))
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.sizes = np.array([r[1] for r in self.rows])
        self.answer_sizes = np.array([r[3] for r in self.rows])
        #: Of each item a bit for every word: whether its answer has it.
        self.in_answer = np.zeros((len(self.rows), 1 << 13), np.uint8)
        for j, r in enumerate(self.rows):
            w = np.fromiter(r[4], np.int64, len(r[4]))
            np.bitwise_or.at(self.in_answer[j], w >> 3, (1 << (w & 7)).astype(np.uint8))
        self.classes = {k: (np.array(i), np.stack([self.rows[j][5] for j in i]).T.astype(np.float32)) for k, i in by.items()}
        self.words = [np.concatenate([np.repeat(np.fromiter(m, np.int64), [x.bit_count() for x in m.values()]) for m in (self.rows[j][2] for j in i)]) for i, _ in self.classes.values()]
        self.cuts = [np.cumsum([0, *(self.rows[j][1] for j in i)]) for i, _ in self.classes.values()]
        self.answers = [np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.fromiter(m, np.int64), [x.bit_count() for x in m.values()]) for m in (self.rows[j][4] for j in i))]) for i, _ in self.classes.values()]
        self.answer_cuts = [np.cumsum([0, *(self.rows[j][3] for j in i)]) for i, _ in self.classes.values()]
        #: Of each item: words needed for a paraphrase, for a literal hit, and of the answer.
        self.needs = [np.array([(PARAPHRASE * self.rows[j][1], LITERAL * self.rows[j][1], ANSWER * self.rows[j][3]) for j in i]).T for i, _ in self.classes.values()]
        self.reach = [max(k, *(self.rows[j][1] for j in i)) // 2 + 1 for k, (i, _) in self.classes.items()]

    def counted(self, cls: int, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a group of items: a number for each of their words (0: none of them), and how often each item and each answer has it. Kept while all that is kept stays under KEPT bytes."""
        if (cls, lo) in self.kept:
            return self.kept[cls, lo]
        cuts, answer_cuts = self.cuts[cls], self.answer_cuts[cls]
        size = min(GROUP, self.needs[cls].shape[1] - lo)
        own = np.concatenate([self.words[cls][cuts[lo] : cuts[lo + size]], self.answers[cls][answer_cuts[lo] : answer_cuts[lo + size]]])
        number = np.zeros(1 << 16, np.int32)
        number[own] = 1
        known = np.nonzero(number)[0]
        number[known] = np.arange(1, len(known) + 1)
        item = np.concatenate([np.repeat(np.arange(size), np.diff(cuts[lo : lo + size + 1])), np.repeat(np.arange(size, 2 * size), np.diff(answer_cuts[lo : lo + size + 1]))])
        counts = np.bincount(number[own] * 2 * size + item, minlength=(len(known) + 1) * 2 * size).reshape(-1, 2 * size).astype(np.float32)
        if sum(x.nbytes + y.nbytes for x, y in self.kept.values()) + number.nbytes + counts.nbytes <= KEPT:
            self.kept[cls, lo] = number, counts
        return number, counts

    def possible(self, words: np.ndarray, cls: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, item): whether enough of the item's words for a paraphrase with its answer, and for a literal hit, are among those that windows of the block are verified on.

        All blocks are counted in one product for each group of items, over the words of that group. This bounds the
        common subsequence from above, so nothing that could be found is passed over.
        """
        reach, n = self.reach[cls], len(words) // BLOCK + 1
        parts = words[np.clip(np.arange(-reach, BLOCK + 4 * reach) + BLOCK * np.arange(n)[:, None], 0, len(words) - 1)]
        needs, out = self.needs[cls], []
        for lo in range(0, needs.shape[1], GROUP):
            number, counts = self.counted(cls, lo)
            there = np.zeros((n, len(counts)), np.float32)
            there[np.arange(n)[:, None], number[parts]] = 1
            there[:, 0] = 0
            held, answered = np.split(there @ counts, 2, axis=1)
            low, high, answer = needs[:, lo : lo + held.shape[1]]
            out.append(((held >= low) & (answered >= answer) | (held >= high), held >= high))
        some, literal = (np.concatenate(x, axis=1) for x in zip(*out))
        return some, literal

    def answerable(self, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of pairs of an item and a stretch words[lo:hi]: whether some part a quarter longer than the answer holds enough of its words, the bound of ``together`` from above."""
        out = np.zeros(len(item), bool)
        for a in range(0, len(item), 1 << 12):
            own, first, last = item[a : a + 4096], lo[a : a + 4096, None], hi[a : a + 4096, None]
            at = first + np.arange((last - first).max())
            part = words[np.minimum(at, len(words) - 1)]
            hit = (self.in_answer[own[:, None], part >> 3] >> (part & 7).astype(np.uint8) & 1).astype(bool) & (at < last)
            total = np.zeros((len(own), hit.shape[1] + 1), np.int32)
            np.cumsum(hit, axis=1, out=total[:, 1:])
            size = self.answer_sizes[own]
            until = np.minimum(np.arange(hit.shape[1]) + (-(-5 * size // 4))[:, None], hit.shape[1])
            out[a : a + 4096] = (np.take_along_axis(total, until, 1) - total[:, :-1]).max(1, initial=0) >= ANSWER * size
        return out

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple]:
        """(document's place, item, overlap, cosine, kind, first word, end) of each item found in each document.

        Documents lie one after another in one array; windows and what is verified stay inside a document.
        """
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        if not sizes.sum():
            return
        words = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), sizes)
        end = np.cumsum(sizes)
        begin = end - sizes
        found: dict[tuple, tuple] = {}
        place = np.arange(len(words)) - begin[owner]
        left = end[owner] - np.arange(len(words))
        flat, begins, ends = words.tolist(), begin.tolist(), end.tolist()
        windows, needed = [], np.zeros(len(words) + 1, np.int64)
        for cls, length in enumerate(self.classes):
            possible, literal = self.possible(words, cls)
            step, half = max(1, length // 8), max(1, length // 2)
            start = np.nonzero((place % step == 0) & ((left > length - step) | (place == 0)))[0]
            # Windows of a document that begin in the same half window are verified together.
            cell = owner[start] * (len(words) // half + 2) + place[start] // half
            edge = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1])
            count = np.diff(np.append(edge, len(start)))
            block = start[edge] // BLOCK
            some = possible.any(1)[block]  # no vectors are needed where no item is possible
            if not some.any():
                continue
            start, block, count = start[np.repeat(some, count)], block[some], count[some]
            edge = np.cumsum(count) - count
            stop = np.minimum(start + length, end[owner[start]])
            windows.append((cls, length, half, start, stop, edge, block, possible, literal))
            needed += np.bincount(start, minlength=len(needed)) - np.bincount(stop, minlength=len(needed))
        if not windows:
            return
        # Running sums over the words of windows alone; of any window all words are there.
        inside = np.cumsum(needed)[:-1] > 0
        at_word = np.concatenate([[0], np.cumsum(inside)])
        cum = np.zeros((at_word[-1] + 1, self.project.shape[1]), np.float32)
        np.cumsum(self.centred[words[inside] & (FEATURES - 1)], axis=0, out=cum[1:])
        for cls, length, half, start, stop, edge, block, possible, literal in windows:
            index, vectors = list(self.classes.values())[cls]
            x = cum[at_word[stop]] - cum[at_word[start]]
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            near = np.maximum.reduceat(x @ vectors, edge, axis=0)
            first, owners = start[edge].tolist(), owner[start[edge]].tolist()
            pairs = np.nonzero((near > COSINE) & possible[block] | literal[block])
            slack = np.maximum(length, self.sizes[index[pairs[1]]]) // 2
            at, doc = start[edge][pairs[0]], owner[start[edge][pairs[0]]]
            close = literal[block][pairs] | self.answerable(words, index[pairs[1]], np.maximum(begin[doc], at - slack), np.minimum(end[doc], at + half + length + slack))
            pairs = pairs[0][close], pairs[1][close]
            for w, i, cosine in zip(*(v.tolist() for v in (*pairs, near[pairs]))):
                item, size, masks, n_answer, answer, _ = self.rows[index[i]]
                doc, at, slack = owners[w], first[w], max(length, size) // 2
                a, b = max(begins[doc], at - slack), min(ends[doc], at + half + length + slack)
                part = flat[a:b]
                least = PARAPHRASE if cosine > COSINE else LITERAL
                hits = list(filter(None, map(masks.get, part)))
                if len(hits) < least * size:
                    continue
                share = in_order(hits, size) / size
                if share < least:
                    continue
                if share < LITERAL and not together(answer, n_answer, part):
                    continue
                kind = "copy" if share >= COPY else "paraphrase"
                if kind == "paraphrase" and common(answer, n_answer, part) < ANSWER * n_answer:
                    continue
                if (share, cosine) > found.get((doc, item), (0, 0, 0.0, 0.0))[2:4]:
                    found[doc, item] = (doc, item, share, cosine, kind, a - begins[doc], b - begins[doc])
        yield from found.values()


def _grouped(docs: list[np.ndarray], most: int = 1 << 14) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of documents of about so many words, with the place of the first."""
    first, held, n = 0, [], 0
    for i, d in enumerate(docs):
        held.append(d)
        n += len(d)
        if n >= most:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


NAMES = ["doc_id", "item_id", "overlap", "cosine", "kind", "start_word", "end_word"]
OUTPUT = "doc_id bigint, item_id bigint, overlap double, cosine double, kind string, start_word bigint, end_word bigint"


#: Bytes that the items of one part take in every worker, as estimated before they are sent.
PART_BYTES = 64 << 20


def item_bytes(text: Column) -> Column:
    """An estimate from above: a bit for each word value, and of every word a mask of the item's length and a few numbers."""
    n = F.regexp_count(text, F.lit(r"\S+")).cast("double")
    return F.lit(float(1 << 13)) + n * (n / 8 + 128) + 4.0 * RANK


def contaminated(docs: DataFrame, benchmark: DataFrame, part_items: int = 20_000, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each document and benchmark item found in it: overlap, cosine, kind and the words searched.

    The benchmark goes to every task, in parts of about ``part_items`` items and ``part_bytes`` bytes at most, drawn by a
    hash, each searched in a pass of its own over all documents. Null texts hold nothing and items without words are found nowhere; a document without
    doc_id gives rows with a null one; repeated rows give repeated results; of windows alike the first counts. Long
    texts are searched whole; further columns go; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    items = rows_of(benchmark, item_id="long", text="string").where(F.col("text").isNotNull())
    n_items, size = items.agg(F.count("*"), F.coalesce(F.sum(item_bytes(F.col("text"))), F.lit(0.0))).first()
    parts = max(-(-n_items // part_items), math.ceil(size / part_bytes))
    words = staged(hashed(docs), "words")
    space = latent_space(words)
    if space is None or not parts:
        return spark.createDataFrame([], OUTPUT)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = None
    for k in range(parts):
        own = _search(words, Items([(r.item_id, r.text) for r in items.where(part == k).collect()], *space))
        found = own if found is None else found.unionByName(own)
    return found


def _search(words: DataFrame, items: Items) -> DataFrame:
    shipped = words.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[first + x[0]], *x[1:]) for first, docs in _grouped([_terms(b) for b in batch.column("words").to_pylist()]) for x in items.search(docs)]
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    return mapped(words, run, OUTPUT)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
